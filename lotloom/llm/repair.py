"""Re-Pair grammar compression of id sequences, in rounds over numpy arrays.

In each round the most frequent adjacent pairs become nonterminals, the more frequent first where
they overlap; rounds go on until no pair is frequent. A shard holds the rules, the length that
each nonterminal expands to, and the remaining sequence, so any range can be decoded by itself.
Symbols are stored in as many bits as the largest needs: sixteen of them as a number, each further
one as a plane of bits.
"""

from __future__ import annotations

import struct

import numpy as np

from . import vectext

MAGIC = b"LLRP0002"
#: A pair is replaced while it occurs so often in a shard.
FREQUENT = 24
#: In a round, pairs at least this share of the most frequent one are taken.
SHARE = 0.2


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(pairs)
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[at], np.diff(np.concatenate([at, [len(ordered)]]))


#: log2 of the tables that pairs are first counted in, where several may share a place.
TABLES = (18, 21)


def _frequent(pairs: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places that may hold one, pairs, counts) of pairs about as frequent as the most frequent.

    A table by hash gives each pair at least its count; only pairs that look frequent there are
    sorted and counted. Without a pair so frequent the result is empty.
    """
    for bits, share in (*((b, SHARE) for b in TABLES), (TABLES[-1], 0.0)):
        with np.errstate(over="ignore"):
            place = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
        rough = np.bincount(place, minlength=1 << bits)
        least = max(frequent, share * rough.max())
        at = np.flatnonzero((rough >= least)[place])
        if not len(at):
            break
        values, counts = _counted(pairs[at])
        if counts.max() >= least:
            return at, values[counts >= least], counts[counts >= least]
    return pairs[:0], pairs[:0], pairs[:0]


def compressed(ids: np.ndarray, symbols: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, sequence): rule k stands for symbol ``symbols`` + k and has two symbols below it."""
    sequence = ids.astype(np.int64)
    left, right, made = [], [], 0
    while len(sequence) > 1:
        pairs = sequence[:-1] * (symbols + made) + sequence[1:]
        at, values, counts = _frequent(pairs, frequent)
        if not len(values):
            break
        rank_of = np.empty(len(values), np.int64)
        rank_of[np.argsort(-counts, kind="stable")] = np.arange(len(values))
        found = np.minimum(np.searchsorted(values, pairs[at]), len(values) - 1)
        good = values[found] == pairs[at]
        at, rank = at[good], rank_of[found[good]]
        # where places overlap, the smaller rank wins; in a run of one rank, every other place
        near = np.diff(at) == 1
        same = near & (np.diff(rank) == 0)
        begin = np.concatenate([[True], ~same])
        run = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - run) % 2 == 0
        beaten = np.zeros(len(at), bool)
        beaten[1:] |= near & (rank[:-1] < rank[1:])
        beaten[:-1] |= near & (rank[1:] < rank[:-1])
        take = even & ~beaten
        at, rank = at[take], rank[take]
        used, place = np.unique(rank, return_inverse=True)
        by_rank = np.argsort(rank_of)
        chosen = values[by_rank[used]]
        left.append(chosen // (symbols + made))
        right.append(chosen % (symbols + made))
        sequence[at] = symbols + made + place
        gone = np.zeros(len(sequence), bool)
        gone[at + 1] = True
        sequence = sequence[~gone]
        made += len(used)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]).astype("<u4"), np.concatenate([none, *right]).astype("<u4"), sequence.astype("<u4")


def expansion_lengths(left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
    """Ids that each rule expands to."""
    out = np.ones(symbols + len(left), np.int64)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[symbols + k] = out[a] + out[b]
    return out[symbols:]


def width(symbols: int) -> int:
    """Bits of a symbol in a file, 16 at least."""
    return max(16, (max(symbols, 1) - 1).bit_length())


def planes(values: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each value, then a plane for each further bit, eight values to a byte."""
    values = values.astype(np.uint32)
    return (values & 0xFFFF).astype("<u2").tobytes() + b"".join(np.packbits((values >> k & 1).astype(bool)).tobytes() for k in range(16, bits))


def from_planes(data: bytes, at: int, count: int, bits: int) -> tuple[np.ndarray, int]:
    """(values, where they end)."""
    out = np.frombuffer(data, "<u2", count, at).astype("<u4")
    at += 2 * count
    step = (count + 7) // 8
    for k in range(16, bits):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=count).astype("<u4") << np.uint32(k)
        at += step
    return out, at


def packed(docs: np.ndarray, bounds: np.ndarray, ids: np.ndarray, symbols: int, known: np.ndarray | None = None) -> bytes:
    """A shard file: the documents' ids and which of them are known (all: None), where each begins, rules,
    expansion lengths, sequence."""
    left, right, sequence = compressed(ids, symbols)
    lengths = expansion_lengths(left, right, symbols)
    bits = width(symbols + len(left))
    long = bits if not len(lengths) else max(bits, int(lengths.max()).bit_length())
    head = struct.pack("<8sQQQQBB", MAGIC, symbols, len(docs), len(left), len(sequence), bits, long)
    known = np.ones(len(docs), bool) if known is None else known
    return head + b"".join([docs.astype("<i8").tobytes(), np.packbits(known).tobytes(), np.diff(bounds).astype("<u4").tobytes(), planes(left, bits), planes(right, bits), planes(lengths, long), planes(sequence, bits)])


class Shard:
    """A shard file in memory; ``known`` tells the documents that have an id."""

    def __init__(self, data: bytes):
        magic, self.symbols, docs, rules, symbols_left, bits, long = struct.unpack_from("<8sQQQQBB", data)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = 42
        self.docs = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.known = np.unpackbits(np.frombuffer(data, np.uint8, (docs + 7) // 8, at), count=docs).astype(bool)
        at += (docs + 7) // 8
        self.bounds = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", docs, at), dtype=np.int64)])
        at += 4 * docs
        self.left, at = from_planes(data, at, rules, bits)
        self.right, at = from_planes(data, at, rules, bits)
        self.lengths, at = from_planes(data, at, rules, long)
        self.sequence, at = from_planes(data, at, symbols_left, bits)
        # what each nonterminal stands for, one after the other; a plain symbol stands for itself
        self.table = self._expanded(np.arange(self.symbols, self.symbols + rules, dtype=np.uint32))
        self.begins = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.ends = np.concatenate([[0], np.cumsum(self._sizes(self.sequence))])

    def _expanded(self, sequence: np.ndarray) -> np.ndarray:
        """Nonterminals are replaced by their two symbols until none is left."""
        while True:
            rule = sequence.astype(np.int64) - self.symbols
            big = rule >= 0
            if not big.any():
                return sequence
            begin = np.cumsum(1 + big) - 1 - big
            out = np.empty(len(sequence) + int(big.sum()), np.uint32)
            out[begin] = sequence
            out[begin[big]] = self.left[rule[big]]
            out[begin[big] + 1] = self.right[rule[big]]
            sequence = out

    def _sizes(self, sequence: np.ndarray) -> np.ndarray:
        out = np.ones(len(sequence), np.int64)
        big = sequence >= self.symbols
        out[big] = self.lengths[sequence[big].astype(np.int64) - self.symbols]
        return out

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``begin`` to ``end``; only the symbols that cover them are expanded."""
        end = int(self.ends[-1]) if end is None else end
        if begin >= end:
            return np.zeros(0, "<u4")
        first = int(np.searchsorted(self.ends, begin, "right")) - 1
        last = int(np.searchsorted(self.ends, end, "left"))
        some = self.sequence[first:last]
        sizes, big = self._sizes(some), some >= self.symbols
        out = np.repeat(some, sizes)
        out[np.repeat(big, sizes)] = vectext.gather(self.table, self.begins[some[big].astype(np.int64) - self.symbols], sizes[big])
        return out[begin - self.ends[first] : end - self.ends[first]].astype("<u4")
