"""op7 and op9 against the library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lotloom.llm import binary_output, packing, repair, tokens

ODD = [None, "", "  ", "a  b", " x", "x ", "\n", "a\n b", "a \n", "a \nb", "x\n  y", "tab\t z", "é ñ ", "A'S 's  it's", "<|endoftext|> a", "q　 w", "z  ", "\x1c a", "İI ΑΣ Σ", "á ́b", "🙂 ok 12 345", "   lead", "\r\n\r\n x", "a\x0b b", "a\x85 b", "the of " * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_librarys_ids(name):
    rng = random.Random(5)
    alphabet = ["a", "B", " ", " ", "\n", "\t", "é", "'s", ".", "1", "the", "<|endoftext|>", "\xa0", "ß", "🙂"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    e = tokens.Encoder(tokens.vocabulary(name))
    for _ in range(2):
        ids, counts = e.encoded(pa.array(texts))
        ends = np.cumsum(counts)
        for text, end, n in zip(texts, ends, counts, strict=True):
            assert ids[end - n : end].tolist() == e.library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_repair_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, [2, 3, 50, 5, 1, 7][seed], [5000, 4097, 20000, 1, 3000, 0][seed]).astype("<u4")
    bounds = np.array([0, len(ids) // 3, len(ids)])
    shard = repair.Shard(repair.packed(np.array([4, 9]), bounds, ids, 50))
    assert (shard.ids() == ids).all() and shard.docs.tolist() == [4, 9] and (shard.bounds == bounds).all()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (shard.ids(a, b) == ids[a:b]).all()
    assert seed != 0 or len(shard.sequence) < len(ids) / 3


def test_symbols_take_the_bits_they_need():
    rng = np.random.default_rng(1)
    for bits in (16, 17, 19, 24):
        values = rng.integers(0, 1 << bits, 1003).astype(np.uint32)
        data = b"xy" + repair.planes(values, bits) + b"z"
        back, at = repair.from_planes(data, 2, len(values), bits)
        assert (back == values).all() and at == len(data) - 1
    assert [repair.width(n) for n in (0, 5, 65536, 65537, 131073)] == [16, 16, 16, 17, 18]
    words = [rng.integers(0, 49_000, rng.integers(3, 9)) for _ in range(3000)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.3, 40_000) % 3000]).astype("<u4")
    data = repair.packed(np.arange(10), np.linspace(0, len(ids), 11).astype(np.int64), ids, 49_152, np.arange(10) != 4)
    shard = repair.Shard(data)
    assert (shard.ids() == ids).all() and shard.known.tolist() == [k != 4 for k in range(10)]
    assert len(data) < len(ids)  # half of what plain 16-bit ids take


def frame(spark, rows):
    return spark.createDataFrame([(t, i, 3) for i, t in rows], "text string, doc_id long, part int").repartition(3)


def test_token_files(spark, monkeypatch):
    rows = [(k * 7 % 101 - 1, t) for k, t in enumerate(ODD * 3)] + [(None, "null id")]
    e = tokens.encoder(tokens.vocabulary(binary_output.VOCABULARY))
    got = sorted(binary_output.token_files(frame(spark, rows), tokens.vocabulary(binary_output.VOCABULARY)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    want = {(i, zlib.crc32(np.array([*e.library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in rows}
    for r in got:
        assert r.start == at and (r.doc_id, r.ids_crc32) in want and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert binary_output.token_files(frame(spark, []), tokens.vocabulary(binary_output.VOCABULARY)).count() == 0


def check_packs(got, longest=1024):
    packs = {}
    for r in got:
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(packs) == list(range(len(packs)))
    used = []
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at and length > 0
            at += length
        assert at <= longest
        used.append(at)
    return used


def test_packing(spark):
    rng = random.Random(2)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(5, "again")] * 3 + [(None, None)] + [(100 + k, "word " * rng.randint(0, 3000)) for k in range(300)]
    got = packing.packed(frame(spark, rows), tokens.vocabulary(packing.VOCABULARY), with_ids=True).collect()
    check_packs(got)
    e = tokens.encoder(tokens.vocabulary(packing.VOCABULARY))
    docs = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, t in rows:
        ids = np.array([*e.library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted({(r.start, r.length, r.ids) for r in docs[i, len(ids) // 4]})
        if i != 5:
            assert b"".join(x for _, _, x in mine) == ids
    assert packing.packed(frame(spark, []), tokens.vocabulary(packing.VOCABULARY)).count() == 0


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(0)
    for _ in range(30):
        histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 1025, 200), rng.integers(1, 300, 200), strict=True)}
        made = packing.patterns(histogram)
        count = {}
        for pattern, c in made:
            assert sum(pattern) <= 1024
            for n in pattern:
                count[n] = count.get(n, 0) + c
        assert count == histogram
        slots = packing.Slots(made)
        seen = set()
        for n, c in histogram.items():
            s, o = slots.placed(np.full(c, n), np.arange(c))
            seen |= {(int(a), int(b)) for a, b in zip(s, o, strict=True)}
        assert len(seen) == sum(histogram.values()) and max(a for a, _ in seen) == slots.packs - 1
