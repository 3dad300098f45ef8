"""Words of whole batches of texts as numpy arrays.

A batch is lower-cased, its separators are blanked and it is split by Arrow kernels; each distinct
word of the batch is then handled once in Python, and everything per occurrence is numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def filled(column: pa.Array) -> pa.Array:
    """Nulls become empty texts; the result is one large_string array with offset 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = pc.fill_null(column.cast(pa.large_string()), "")
    return out if out.offset == 0 else pa.concat_arrays([out])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large_string or large_binary array of offset 0."""
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[: len(texts) + 1] if off is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, raw


def translated(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Each byte replaced through a table of 256. The table maps no byte over 127 to another."""
    offsets, raw = buffers(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(table[raw].tobytes()))


def word_table(extra: bytes = b"") -> np.ndarray:
    """A-Z to lower case; of the others below 128 only 0-9, a-z and ``extra`` stay, the rest are blanks."""
    table = np.full(256, 32, np.uint8)
    keep = [*range(48, 58), *range(97, 123), *range(128, 256), *extra]
    table[keep] = keep
    table[65:91] = np.arange(97, 123)
    return table


ASCII_WORDS = word_table()


class Words:
    """codes: a number per word; offsets: where each text's words begin; names: word by number."""

    def __init__(self, texts: pa.Array, table: np.ndarray | None = ASCII_WORDS):
        if table is not None:
            texts = translated(texts, table)
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_pylist()
        if "" in names:  # a text that begins or ends with blanks has empty pieces there
            empty = names.index("")
            owner = np.repeat(np.arange(len(lengths)), lengths)
            good = codes != empty
            lengths = np.bincount(owner[good], minlength=len(lengths)).astype(np.int64)
            codes = codes[good]
        self.codes, self.names = codes, names
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        self.lengths = lengths

    @property
    def owner(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of each number (two multiplications and three shifts), as unsigned."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def name_hashes(names: list[str], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(w, seed) for w in names), np.uint64, len(names))


def gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces table[start:start+length] one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return table[:0]
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(ends[-1])
    return table[at]
