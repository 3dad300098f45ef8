"""Ranked lexical search over a bit-sliced impact index.

A first pass counts, by Arrow batch, each document's terms and how often those of the queries stand in
it; document frequencies and lengths are then sums over that table. A task cuts its documents into blocks,
in order of doc_id, and indexes each: a term's impacts are kept as bit slices, one bitmap over the block's
documents for each bit of the impact, of which only the 64-bit words with a document are held. Scores
of many queries are added at once, slice by slice with carries, and the best documents of a block are found
from the most significant slice down: a slice either splits the candidates or all of its documents are in.
Equal scores fall to the lowest bits, which are the smallest ids.

A task keeps the best documents of each query over its blocks, so what is shuffled is a few rows for each
task and query. Queries are taken in groups of bounded size; nothing of the documents is collected but one
count for each term of a group.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, vectext

#: Best documents a query gets.
TOP = 20
#: Documents of a block (a multiple of 64), queries scored at once, characters of query texts in a group, about.
BLOCK, TOGETHER, GROUP = 4096, 64, 4 << 20
#: The weight of the length in a document's m and the impact's own.
FLOOR, SHARE, UNIT, STEEP, SLOPE = 100, 25, 1_000_000_000, 1000, 12
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text: str | None) -> list[str]:
    """The terms of one query."""
    return TERM.findall((text or "").translate(LOWER))


def counted(docs: DataFrame, codes: dict[str, int]) -> DataFrame:
    """(doc_id, n, codes, tfs) of each document with a term: how many it has, and how often those of ``codes`` stand in it."""
    names = np.array(sorted(codes), object)
    number = {w: codes[w] for w in names}

    def by_batch(batches):
        for batch in batches:
            words = vectext.Words(vectext.filled(batch.column("text")))
            of = np.fromiter((number.get(w, -1) for w in words.names), np.int64, len(words.names))
            here = of[words.codes] if len(of) else np.zeros(0, np.int64)
            pairs, tf = np.unique((words.owner * (len(number) + 1) + here)[here >= 0], return_counts=True)
            owner = pairs // (len(number) + 1)
            some = np.flatnonzero(words.lengths)
            bounds = pa.array(np.concatenate([np.searchsorted(owner, some), [len(owner)]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(some)), pa.array(words.lengths[some]),
                pa.ListArray.from_arrays(bounds, pa.array((pairs % (len(number) + 1)).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int64))),
            ], ["doc_id", "n", "codes", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(by_batch, "doc_id long, n long, codes array<int>, tfs array<long>")


class Index:
    """Bit slices of one block: for each term and each 64 documents of which one has it, ``bits`` words."""

    def __init__(self, at: np.ndarray, codes: np.ndarray, impacts: np.ndarray, count: int):
        """Postings: place of the document in the block, term, impact."""
        keep = impacts > 0
        at, codes, impacts = at[keep], codes[keep], impacts[keep]
        order = np.lexsort((at, codes))
        at, codes, impacts = at[order], codes[order], impacts[order].astype(np.uint64)
        self.words = -(-max(count, 1) // 64)
        self.bits = int(impacts.max()).bit_length() if len(impacts) else 0
        cell = codes.astype(np.int64) * self.words + (at >> 6)
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        self.term, self.word = codes[begins], (at[begins] >> 6)
        one = np.uint64(1) << (at & 63).astype(np.uint64)
        self.slices = np.empty((len(begins), self.bits), np.uint64)
        for b in range(self.bits):  # each document stands once in a word, so sums are unions
            self.slices[:, b] = np.add.reduceat(np.where(impacts >> np.uint64(b) & np.uint64(1), one, np.uint64(0)), begins)

    def bitmaps(self, wanted: np.ndarray) -> np.ndarray:
        """[term, bit, word] of the sorted terms ``wanted``, and a last term that no document has."""
        out = np.zeros((len(wanted) + 1, self.bits, self.words), np.uint64)
        mine = np.flatnonzero(np.isin(self.term, wanted))
        out[np.searchsorted(wanted, self.term[mine]), :, self.word[mine]] = self.slices[mine]
        return out


def added(total: list[np.ndarray], bitmaps: np.ndarray, shift: int) -> None:
    """Add [query, bit, word] to the score slices ``total`` with carries, each bit ``shift`` places up."""
    carry = np.zeros_like(total[0])
    for b in range(shift, len(total)):
        if b - shift < bitmaps.shape[1]:
            x = bitmaps[:, b - shift]
            half = total[b] ^ x
            carry, total[b] = total[b] & x | half & carry, half ^ carry
        elif carry.any():
            carry, total[b] = total[b] & carry, total[b] ^ carry
        else:
            break


def best(total: list[np.ndarray], top: int) -> np.ndarray:
    """[query, document] true for the ``top`` highest scores above 0, the first of equal ones."""
    left, sure = np.bitwise_or.reduce(total), np.zeros_like(total[0])
    for slices in reversed(total):
        tried = sure | left & slices
        many = np.bitwise_count(tried).sum(1, keepdims=True) > top
        left, sure = np.where(many, left & slices, left & ~slices), np.where(many, sure, tried)
    open_, chosen = (np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(bool) for x in (left, sure))
    room = top - chosen.sum(1, keepdims=True)
    return chosen | open_ & (np.cumsum(open_, axis=1) <= room)


def block_scores(index: Index, queries: list[list[tuple[int, int]]], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the best documents of a block; a query is a list of (term, shift)."""
    found = [(np.zeros(0, np.int64),) * 3]
    for begin in range(0, len(queries), TOGETHER):
        some = queries[begin : begin + TOGETHER]
        present = np.intersect1d(np.unique(index.term), np.array(sorted({t for q in some for t, _ in q}), np.int64))
        if not len(present):
            continue
        bitmaps = index.bitmaps(present)
        place = {t: k for k, t in enumerate(present.tolist())}
        mine = [[(place[t], s) for t, s in q if t in place] for q in some]
        width = max(sum(((1 << index.bits) - 1) << s for _, s in q) for q in mine).bit_length()
        total = [np.zeros((len(some), index.words), np.uint64) for _ in range(min(width, 63))]
        for shift in sorted({s for q in mine for _, s in q}):
            rows = [[t for t, s in q if s == shift] for q in mine]
            for step in range(max(map(len, rows))):
                added(total, bitmaps[[r[step] if step < len(r) else len(present) for r in rows]], shift)
        query, at = np.nonzero(best(total, top))
        score = np.zeros(len(query), np.int64)
        for b, slices in enumerate(total):
            score |= (slices[query, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
        found.append((query + begin, at, score))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def impacts(counts: DataFrame, queries: list[list[tuple[int, int]]], weights: np.ndarray, documents: int, length: int, top: int, block: int) -> DataFrame:
    """(query, doc_id, score): for each task the best documents of each query."""

    def first(query, ids, none, score):
        order = np.lexsort((ids, none, -score, query))
        query, ids, none, score = query[order], ids[order], none[order], score[order]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        keep = rank < top
        return query[keep], ids[keep], none[keep], score[keep]

    def ranked_block(table: pa.Table):
        none = table.column("doc_id").is_null().to_numpy()
        ids = table.column("doc_id").fill_null(0).to_numpy()
        order = np.lexsort((ids, none))
        table, ids, none = table.take(pa.array(order)), ids[order], none[order]
        held = table.column("codes").combine_chunks()
        at = np.repeat(np.arange(len(ids)), held.value_lengths().to_numpy(zero_copy_only=False))
        codes, tf = held.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()
        m = FLOOR - SHARE + SHARE * table.column("n").to_numpy() * documents // length
        query, place, score = block_scores(Index(at, codes, weights[codes] * (UNIT * tf // (STEEP * tf + SLOPE * m[at])), len(ids)), queries, top)
        return query, ids[place], none[place], score

    def by_task(batches):
        best_yet = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        waiting, rows = [], 0
        for batch in (*batches, None):
            if batch is not None:
                for begin in range(0, batch.num_rows, block):
                    part = batch.slice(begin, block)
                    waiting.append(part)
                    rows += part.num_rows
            while rows >= block or batch is None and rows:
                table = pa.Table.from_batches(waiting)
                best_yet = first(*(np.concatenate(x) for x in zip(best_yet, ranked_block(table.slice(0, block)), strict=True)))
                waiting = table.slice(block).to_batches()
                rows = max(0, rows - block)
        query, ids, none, score = best_yet
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(ids, mask=none), pa.array(score)], ["query", "doc_id", "score"])

    return counts.where(F.size("codes") > 0).select("doc_id", "n", "codes", "tfs").mapInArrow(by_task, "query int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Documents and items without a term (null, empty, marks alone) get no rows, nor do items none of whose terms is
    in a document. Each repeated document counts and is ranked; null ids come last among equal scores. Items that
    repeat id and text count once; different texts of one id are ranked each on its own. Texts of any length count
    whole. Where ``docs`` or ``items`` is empty there are no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    asked = scratch.table(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct(), "items")
    groups = -(-(asked.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // group)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        rows = sorted(((r.item_id, terms(r.text)) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()), key=lambda r: len(r[1]))
        codes = {w: k for k, w in enumerate(sorted({w for _, t in rows for w in t}))}
        counts = scratch.table(counted(docs, codes), "counts")
        documents, length = counts.agg(F.count("*"), F.sum("n")).first()
        weights = np.zeros(len(codes), np.int64)
        for r in counts.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # terms of this group at most
            weights[r.code] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))
        queries = [[(codes[w], s) for w, times in Counter(t).items() for s in range(times.bit_length()) if times >> s & 1] for _, t in rows]
        found = impacts(counts, queries, weights, documents, length or 1, top, block)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], "query int, item_id long")
        out = out.unionByName(first.join(ids, "query").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_impact_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with q as materialized (select row_number() over () as item, item_id, {_TERMS} as t from (select distinct item_id, text from benchmark)),
qt as materialized (select item, any_value(item_id) as item_id, term, count(*) as times from (select item, item_id, unnest(t) as term from q) group by item, term),
d as materialized (select row_number() over () as rid, doc_id, {_TERMS} as t from documents),
k as materialized (select rid, doc_id, len(t) as n from d where len(t) > 0),
s as (select count(*) as docs, cast(sum(n) as bigint) as terms from k),
p as materialized (select rid, term, count(*) as tf from (select rid, unnest(t) as term from d) where term in (select term from qt) group by rid, term),
w as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from p, s group by term),
i as (select rid, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))) as impact from p join w using (term) join k using (rid), s),
h as (select item, any_value(item_id) as item_id, rid, cast(sum(times * impact) as bigint) as score from qt join i using (term) group by item, rid having sum(times * impact) > 0),
r as (select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as int) as rank, doc_id, score from h join k using (rid))
select item_id, rank, doc_id, score from r where rank <= {TOP}
"""
