"""Token ids in grammar-compressed binary shards, in ascending doc_id order, and back."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repair, scratch, tokens

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Ids that a shard holds before it is closed at the end of a document.
SHARD_IDS = 1_500_000

MANIFEST = "part long, number long, file string, n_docs long, n_tokens long, n_bytes long"


def write_shards(docs: DataFrame, folder: str, path: str, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, sort by doc_id, and write shards into ``folder``; the manifest has a row for each.

    Texts are dealt out by ranges of (doc_id, hash of the text), so equal ids stay in order and do
    not load one task. Null texts count as empty; null ids come first, as Spark sorts them, and
    stay null. A text of any length is encoded whole, in one shard. The order of shards is that of
    (part, number).
    """

    def written(batches):
        encode, to = tokens.encoder(path), scratch.filesystem(folder)
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        to[0].create_dir(to[1], recursive=True)

        def closed():
            nonlocal number
            ids = np.concatenate([h[2] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            data = repair.packed(np.concatenate([h[0] for h in held]), np.concatenate([[0], np.cumsum(sizes)]), ids, encode.size, np.concatenate([h[3] for h in held]))
            name = f"{part:08d}-{number:06d}-{uuid.uuid4().hex}.llrp"
            with to[0].open_output_stream(f"{to[1]}/{name}") as out:
                out.write(data)
            row = (part, number, name, len(sizes), len(ids), len(data))
            number += 1
            held.clear()
            return row

        def as_batch(row):
            return pa.RecordBatch.from_pylist([dict(zip(("part", "number", "file", "n_docs", "n_tokens", "n_bytes"), row, strict=True))], pa.schema([("part", pa.int64()), ("number", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = tokens.with_end(*encode.encoded(batch.column(1)), end)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            names = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(names):
                room = shard_ids - sum(len(h[2]) for h in held)
                stop = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + room, "right")) - 1)
                held.append((names[begin:stop], np.diff(bounds[begin : stop + 1]), ids[bounds[begin] : bounds[stop]], known[begin:stop]))
                begin = stop
                if sum(len(h[2]) for h in held) >= shard_ids or begin < len(names):
                    yield as_batch(closed())
        if held:
            yield as_batch(closed())

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(written, MANIFEST)


def with_starts(manifest: DataFrame) -> DataFrame:
    """``start``: ids in all shards before, summed in two steps so that no task gets all rows."""
    grouped = manifest.withColumn("block", F.floor(F.col("part") / 256))
    inner = Window.partitionBy("block").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    totals = grouped.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "before")
    return grouped.join(before, "block").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).drop("block", "before")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each document of the shards: doc_id, start, n_tokens, ids_crc32, ids (little-endian)."""

    def read(batches):
        fs, root = scratch.filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    shard = repair.Shard(file.read())
                for at in range(0, len(shard.docs), 2000):
                    bounds = shard.bounds[at : at + 2001]
                    data = shard.ids(int(bounds[0]), int(bounds[-1])).tobytes()
                    cut = ((bounds - bounds[0]) * 4).tolist()
                    pieces = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    docs = pa.array(shard.docs[at : at + 2000], mask=~shard.known[at : at + 2000])
                    yield pa.RecordBatch.from_arrays([docs, pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(pieces, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return manifest.select("file", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_files(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Write all of ``docs`` (doc_id, text) as shards in the shared folder and read them back.

    Empty tables give no rows; null ids stay null, repeated rows stay. Columns besides doc_id and
    text are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark, 4000)
    folder = scratch.new_folder(spark, "shards")
    manifest = with_starts(scratch.table(write_shards(docs, folder, path, end), "manifest"))
    shards = max(1, manifest.count())
    return read_shards(manifest.repartition(min(shards, 20_000), "file"), folder)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, written in grammar-compressed shards and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files(docs, tokens.vocabulary(VOCABULARY)).drop("ids")
