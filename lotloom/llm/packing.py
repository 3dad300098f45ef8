"""Packing: shortest-pack-first over the histogram of piece lengths.

Only the histogram (as many numbers as a sequence has places) meets in one place. Lengths are
placed longest first, each on the packs that are filled least and still have room, as counts of
packing patterns; patterns are then joined back to the pieces by each piece's rank among those of
its length. Ranks come from counts by task, so no task gets all pieces of a common length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens

VOCABULARY = "byte_bpe_50k.json"
END = 0
LENGTH = 1024

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long, ids binary"


def pieces(docs: DataFrame, path: str, end: int = END, longest: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Every document's ids and the end id, cut into full pieces and one rest.

    Each row has the task (part) and its rank among the pieces of its length in that task.
    """

    def cut(batches):
        encode, part = tokens.encoder(path), TaskContext.get().partitionId()
        met = np.zeros(longest + 1, np.int64)
        for batch in batches:
            ids, bounds = tokens.with_end(*encode.encoded(batch.column(1)), end)
            total = np.diff(bounds)
            number = -(-total // longest)
            owner = np.repeat(np.arange(len(total)), number)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
            start = within * longest
            length = np.minimum(longest, total[owner] - start)
            order = np.argsort(length, kind="stable")
            ranks = np.empty(len(length), np.int64)
            counts = np.bincount(length, minlength=longest + 1)
            first = np.cumsum(counts) - counts
            ranks[order] = np.arange(len(length)) - first[length[order]]
            ranks += met[length]
            met += counts
            at = bounds[:-1][owner] + start
            data = [ids[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array(total[owner]), pa.array(np.full(len(owner), part)), pa.array(ranks), pa.array(data if with_ids else [None] * len(data), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE)


def patterns(histogram: dict[int, int], longest: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack in order, number of such packs), shortest pack first over the histogram."""
    open_: dict[int, list[list]] = {}  # room left: [pattern, count]
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        for room in range(longest, length - 1, -1):
            at = open_.get(room)
            while left and at:
                pattern, count = at[-1]
                fit = min(count, left)
                if fit < count:
                    at[-1][1] -= fit
                else:
                    at.pop()
                open_.setdefault(room - length, []).append([(*pattern, length), fit])
                left -= fit
            if not left:
                break
        if left:
            open_.setdefault(longest - length, []).append([(length,), left])
    merged: dict[tuple[int, ...], int] = {}
    for at in open_.values():
        for pattern, count in at:
            merged[pattern] = merged.get(pattern, 0) + count
    return sorted(merged.items())


class Slots:
    """For each length, which ranks go to which packs: arrays over the patterns, not over packs."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]], longest: int = LENGTH):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        base, self.offsets = 0, []
        for pattern, count in made:
            at, by = 0, {}
            for n in pattern:
                by.setdefault(n, []).append(at)
                at += n
            for n, places in by.items():
                rows.setdefault(n, []).append((taken.get(n, 0), len(places), base, len(self.offsets)))
                self.offsets += places
                taken[n] = taken.get(n, 0) + count * len(places)
            base += count
        self.packs = base
        self.begin = np.zeros(longest + 2, np.int64)
        for n, found in rows.items():
            self.begin[n + 1] = len(found)
        self.begin = np.cumsum(self.begin)
        flat = [r for n in sorted(rows) for r in rows[n]]
        self.first, self.per_pack, self.base, self.at = (np.array(x, np.int64) for x in (zip(*flat, strict=True) if flat else [()] * 4))
        self.offsets = np.array(self.offsets, np.int64)
        # ranks of all lengths on one axis, so that one search finds every slot
        self.shift = np.concatenate([[0], np.cumsum([taken.get(n, 0) for n in range(longest + 1)])]).astype(np.int64)
        self.axis = np.concatenate([self.first[self.begin[n] : self.begin[n + 1]] + self.shift[n] for n in range(longest + 1)]) if flat else self.first

    def placed(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of pieces by length and rank among all of that length."""
        row = np.searchsorted(self.axis, rank + self.shift[length], "right") - 1
        within = rank - self.first[row]
        return self.base[row] + within // self.per_pack[row], self.offsets[self.at[row] + within % self.per_pack[row]]


def packed(docs: DataFrame, path: str, end: int = END, longest: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces with the sequence and offset they got; ``with_ids`` adds their ids (uint32, little-endian).

    A null text counts as empty and is one piece with the end id. Null and repeated ids are kept,
    each row packed for itself. Texts of any length are encoded whole and cut. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark, 4000)
    cut = scratch.table(pieces(docs, path, end, longest, with_ids), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("pieces"))
    histogram = {r.length: r.pieces for r in by_part.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    slots = Slots(patterns(histogram, longest), longest)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("part", "length", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("shift"))
    ranked = cut.join(shifts, ["part", "length"])

    def placed(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            sequence, offset = slots.placed(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset), batch.column(6)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    wanted = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).alias("rank"), "ids")
    out = wanted.mapInArrow(placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out if with_ids else out.drop("ids")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every document, packed into sequences of at most 1024 ids."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.vocabulary(VOCABULARY))
