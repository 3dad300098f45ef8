"""WARC archives: written by tasks, indexed first, and read back by coalesced byte ranges.

Each task writes archives of gzip members, one for each record, and an index row with offset,
length, URL and digest per record. Reading takes index rows: they are sorted by file and offset,
neighbouring ranges are joined into few reads, and every record is parsed from its own member.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Bytes of an archive before the next one is begun; bytes between two ranges that are read along;
#: bytes of one read at most, unless a single record is longer.
ARCHIVE, GAP, READ = 64 << 20, 64 << 10, 8 << 20
#: Spreads the rows of one digest over so many tasks where they meet the response's id.
SALTS = 16

INDEX = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to for each row.

    The row with the smallest page_id among equal payloads of LEAST bytes or more is the response;
    rows that share that id and payload are all responses, and so is a row without an id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    small = rows.select("page_id", "payload_digest", F.octet_length("payload").alias("n")).where(f"n >= {LEAST} and page_id is not null")
    first = small.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS))).join(salted, ["payload_digest", "salt"], "left")
    revisit = F.col("first") < F.col("page_id")
    return met.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: an HTTP response with its payload, or a revisit with headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Target-URI: " + " ".join(url.split()),
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """A record's page_id, url, type, refers_to, stated digest, and the payload if it holds one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]

    def number(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri", ""), "record_type": fields["warc-type"], "refers_to": number("warc-refers-to"), "stated": fields.get("warc-payload-digest", "").removeprefix("sha256:"), "payload_bytes": sizes[0] if sizes else len(payload), "payload": payload if fields["warc-type"] == "response" else None}


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``with_types`` as archives into ``folder``; returns their index."""

    def written(batches):
        fs, root = scratch.filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                rows = []
                for page_id, url, payload, digest, kind, refers_to in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"{part:08d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(record(page_id, url, payload, digest, kind, refers_to), 3, mtime=0)
                    out.write(member)
                    rows.append((page_id, url, digest, kind, name, at, len(member)))
                    at += len(member)
                if out is not None:
                    out.flush()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "url", "payload_digest", "record_type", "file", "offset", "length"])
        if out is not None:
            out.close()

    return typed.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to").mapInArrow(written, INDEX)


def ranges(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, begin, end, members) for sorted (file, offset, length): neighbours within GAP are one read."""
    out: list[tuple[str, int, int, list[tuple[int, int]]]] = []
    for file, offset, length in rows:
        if out and out[-1][0] == file and offset - out[-1][2] <= GAP and offset + length - out[-1][1] <= READ:
            _, begin, end, members = out[-1]
            members.append((offset, length))
            out[-1] = (file, begin, max(end, offset + length), members)
        else:
            out.append((file, offset, offset + length, [(offset, length)]))
    return out


def read_records(index: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """The records of these index rows, read from the archives: page_id, url, payload_bytes,
    payload_digest (of the bytes read; as stated for revisits, which hold none), record_type,
    refers_to, payload.
    """

    def read(batches):
        fs, root = scratch.filesystem(folder)
        name, file = None, None
        for batch in batches:
            for path, begin, end, members in ranges(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                if path != name:
                    name, file = path, fs.open_input_file(f"{root}/{path}")
                data = file.read_at(end - begin, begin)
                rows = []
                for offset, length in members:
                    r = parsed(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                    got = r.pop("payload")
                    stated = r.pop("stated")
                    if got is not None:
                        r["payload_bytes"] = len(got)
                    rows.append(r | {"payload_digest": stated if got is None else hashlib.sha256(got).hexdigest(), "payload": got})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    spans = index.select("file", "offset", "length")
    dealt = spans.repartitionByRange(parts, "file", "offset") if parts else spans.repartitionByRange("file", "offset")
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archived(pages: DataFrame) -> tuple[DataFrame, str]:
    """(index, folder) of archives that hold a record for each row of ``pages`` (page_id, url, html).

    A null html is an empty payload, a null url an empty one; pages of any length are written whole, each a record of its
    own, and an empty table gives an empty index. Other columns are not read, whatever their names. The index is a table
    of its own: only archives of tasks that ended well are in it.
    """
    spark = pages.sparkSession
    scratch.small_batches(spark)
    folder = scratch.new_folder(spark, "archives")
    return scratch.table(write_archives(with_types(pages), folder), "index"), folder


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    index, folder = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return read_records(index, folder, max(8, size // (8 << 20) + 1)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha256(h) as digest from p),
m as (select digest, min(page_id) as first from d group by digest)
select page_id, cast(n as bigint) as payload_bytes, d.digest as payload_digest,
       case when n >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and first < page_id then first end as refers_to
from d join m on d.digest = m.digest
"""
