"""Media columns: Netpbm and BMP pictures as binary columns, decoded to numpy arrays.

A picture is resized by area with an integral image, written as a tile of an NPY file, and described
by a difference hash of the tile that is read back. ``documents`` become pictures of 64 samples a
row, which is lossless.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

#: Samples in a row of the picture that a text becomes.
ROW = 64
#: Width and height of the tile that the difference hash compares; each row gives WIDE - 1 bits.
WIDE, HIGH = 9, 8
#: Tiles of one NPY file at most.
TILES = 50_000


def netpbm_encoded(samples: np.ndarray) -> bytes:
    """Raw PGM (two dimensions) or PPM (three, with three channels) of 8-bit samples."""
    if samples.dtype != np.uint8 or samples.ndim not in (2, 3) or samples.ndim == 3 and samples.shape[2] != 3:
        raise ValueError("8-bit samples of shape (height, width) or (height, width, 3) are needed")
    kind = b"P5" if samples.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.tobytes()


def bmp_encoded(samples: np.ndarray) -> bytes:
    """8-bit grey BMP with a palette, or 24-bit; rows from the bottom up, padded to four bytes."""
    grey = samples.ndim == 2
    high, wide = samples.shape[:2]
    rows = samples if grey else samples[:, :, ::-1].reshape(high, wide * 3)
    padded = np.zeros((high, (rows.shape[1] + 3) // 4 * 4), np.uint8)
    padded[:, : rows.shape[1]] = rows
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    colours = palette.tobytes() if grey else b""
    begin = 54 + len(colours)
    head = struct.pack("<2sIHHI", b"BM", begin + padded.size, 0, 0, begin)
    info = struct.pack("<IiiHHIIiiII", 40, wide, high, 1, 8 if grey else 24, 0, padded.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + colours + padded[::-1].tobytes()


def _netpbm_decoded(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    wanted = 2 if kind in (1, 4) else 3
    while len(numbers) < wanted:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("a Netpbm header ends too soon")
        numbers.append(int(data[at:end]))
        at = end
    at += 1  # the one blank after the header
    wide, high = numbers[:2]
    most = 1 if wanted == 2 else numbers[2]
    if not 0 < most < 65536 or wide < 0 or high < 0:
        raise ValueError("a Netpbm header with sizes out of range")
    channels = 3 if kind in (3, 6) else 1
    count = wide * high * channels
    if kind == 4:
        step = (wide + 7) // 8
        if len(data) - at < step * high:
            raise ValueError("a Netpbm picture with samples missing")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, step * high, at).reshape(high, step), axis=1)[:, :wide]
        return ((1 - bits) * 255).astype(np.uint8)
    if kind == 1:
        bits = np.array([b - 48 for b in data[at - 1 :] if b in (48, 49)][:count], np.uint8)
        if len(bits) < count:
            raise ValueError("a Netpbm picture with samples missing")
        return ((1 - bits) * 255).astype(np.uint8).reshape(high, wide)
    if kind in (2, 3):
        flat = np.array(data[at - 1 :].split()[:count], dtype=np.int64)
    else:
        form = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
        if len(data) - at < count * form.itemsize:
            raise ValueError("a Netpbm picture with samples missing")
        flat = np.frombuffer(data, form, count, at)
    if len(flat) < count:
        raise ValueError("a Netpbm picture with samples missing")
    if most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    shape = (high, wide, 3) if channels == 3 else (high, wide)
    return flat.astype(np.uint8).reshape(shape)


def _bmp_decoded(data: bytes) -> np.ndarray:
    begin, size, wide, high, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or depth not in (8, 24, 32):
        raise ValueError("only plain BMP of 8, 24 or 32 bits is read")
    down, high = high < 0, abs(high)
    step = (wide * depth // 8 + 3) // 4 * 4
    if len(data) - begin < step * high:
        raise ValueError("a BMP picture with samples missing")
    rows = np.frombuffer(data, np.uint8, step * high, begin).reshape(high, step)[:, : wide * depth // 8]
    rows = rows if down else rows[::-1]
    if depth == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        colours = np.zeros((256, 4), np.uint8)
        colours[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)
        if (colours[:, 0] == colours[:, 1]).all() and (colours[:, 1] == colours[:, 2]).all():
            return colours[:, 0][rows]
        return colours[:, 2::-1][rows]
    return np.ascontiguousarray(rows.reshape(high, wide, depth // 8)[:, :, 2::-1])


def decoded(data: bytes) -> np.ndarray:
    """The samples of a Netpbm (P1 to P6) or BMP picture, 8 bits each; ValueError for other data."""
    if len(data) > 2 and data[:1] == b"P" and 49 <= data[1] <= 54:
        return _netpbm_decoded(data)
    if data[:2] == b"BM" and len(data) >= 54:
        return _bmp_decoded(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resized(samples: np.ndarray, wide: int = WIDE, high: int = HIGH) -> np.ndarray:
    """Means over the areas that each target sample covers, edges in part, from an integral image."""
    grey = samples if samples.ndim == 2 else samples @ np.array([0.299, 0.587, 0.114])
    rows, columns = grey.shape
    if not rows or not columns:
        return np.zeros((high, wide), np.uint8)
    whole = np.zeros((rows + 1, columns + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])

    def between(at: np.ndarray, values: np.ndarray) -> np.ndarray:
        low = np.minimum(at.astype(np.int64), len(values) - 2)
        part = (at - low).reshape(-1, *[1] * (values.ndim - 1))
        return values[low] * (1 - part) + values[low + 1] * part

    at_rows = between(np.linspace(0, rows, high + 1), whole)
    at = between(np.linspace(0, columns, wide + 1), at_rows.T).T
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return np.clip(np.rint(sums / (rows * columns / (wide * high))), 0, 255).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    """Hexadecimal: a bit for each sample and its right neighbour, set where the right one is brighter."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy_encoded(tiles: np.ndarray) -> bytes:
    """The array as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, tiles, allow_pickle=False)
    return out.getvalue()


def written_tiles(tiles: list[np.ndarray], folder: str) -> tuple[str, np.ndarray]:
    """Write tiles as one NPY file of shape (tiles, HIGH, WIDE) and read it back: (file name, array).

    The name is new for each attempt of a task, so that a repeated task leaves nothing half written
    under a name that its rows carry.
    """
    fs, root = scratch.filesystem(folder)
    fs.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.npy"
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(npy_encoded(np.stack(tiles)))
    with fs.open_input_file(f"{root}/{name}") as file:
        return name, np.load(io.BytesIO(file.read()), allow_pickle=False)


def text_picture(text: str | None) -> bytes:
    """The UTF-8 bytes, zeros up to a positive multiple of 64, as a raw PGM of 64 samples a row."""
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // ROW))
    return b"P5\n%d %d\n255\n" % (ROW, rows) + raw + bytes(rows * ROW - len(raw))


def text_media(docs: DataFrame) -> DataFrame:
    """``documents`` as (doc_id, n_bytes, media): a media column of PGM pictures, one for each row.

    A null text counts as empty and gives one row of zeros. Rows are kept as they come: a null or
    repeated doc_id stays. Columns besides doc_id and text are not read.
    """

    def made(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([text_picture(t) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, "doc_id long, n_bytes long, media binary")


def described(pictures: DataFrame, folder: str) -> DataFrame:
    """What a table with a media column shows: each picture is decoded, resized, written and hashed.

    Adds payload (the samples in row order), tile_file and tile_row (where the tile of HIGH by WIDE
    stands in ``folder``) and feature (the difference hash of the tile as read back). A null or
    unreadable picture gets nulls there. A picture of any size is read whole, one at a time. Rows
    that repeat are described each; an empty table stays empty. Other columns pass through; columns
    of the new names are replaced.
    """
    scratch.small_batches(pictures.sparkSession)
    new = ("payload", "tile_file", "tile_row", "feature")
    keep = [c for c in pictures.columns if c not in new]
    rows = pictures.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("tile_file", T.StringType()), T.StructField("tile_row", T.IntegerType()), T.StructField("feature", T.StringType())])
    at = keep.index("media")

    def made(batches):
        for batch in batches:
            payloads, tiles, where = [], [], []
            for data in batch.column(at).to_pylist():
                try:
                    samples = decoded(data or b"")
                except (ValueError, struct.error):
                    samples = None
                payloads.append(None if samples is None else samples.tobytes())
                where.append(None if samples is None else len(tiles))
                if samples is not None:
                    tiles.append(area_resized(samples))
            name, read = written_tiles(tiles, folder) if tiles else ("", [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array([None if k is None else name for k in where], pa.string()), pa.array(where, pa.int32()), pa.array([None if k is None else difference_hash(read[k]) for k in where], pa.string())], [*keep, *new])

    return rows.mapInArrow(made, schema)


def text_features(docs: DataFrame) -> DataFrame:
    """Store each text as a picture, read the stored bytes back, and digest what was read.

    The media column is written once to the shared folder and everything returned comes from the
    bytes read there; tile_file and tile_row say where a row's tile is. A picture is read, decoded
    and digested within one task, so no samples leave it. Null texts count as empty; a text of any
    length is one picture; repeated rows and null ids stay; an empty table gives no rows. Columns
    besides doc_id and text are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    stored, folder = scratch.table(text_media(docs), "media"), scratch.new_folder(spark, "tiles")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_file", "tile_row"]

    def made(batches):
        rows: list[tuple] = []
        tiles: list[np.ndarray] = []

        def closed():
            name, read = written_tiles(tiles, folder)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([difference_hash(t) for t in read], pa.string()), pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32())], names)
            rows.clear()
            tiles.clear()
            return out

        for batch in batches:
            for doc_id, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                samples = decoded(data)
                payload = samples.tobytes()
                tiles.append(area_resized(samples))
                rows.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest()))
                if len(rows) >= TILES:
                    yield closed()
        if rows:
            yield closed()

    return stored.mapInArrow(made, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_file string, tile_row int")


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Every document as a PGM picture, stored, read back and described."""
    return text_features(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tile_file", "tile_row")
