"""op8 against brute force, and the estimate against the similarity it estimates."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lotloom.llm import minhash_dedup as m


@pytest.mark.parametrize("case", range(4))
def test_signature_estimates_probability_jaccard(case):
    rng = np.random.default_rng(case)
    names = rng.integers(1, 2**63, 400).astype(np.uint64)
    x, y = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 280).astype(float)
    a, b = dict(zip(names[:300].tolist(), x, strict=True)), dict(zip(names[120:].tolist(), y, strict=True))
    if case == 3:
        a, b = {names[0]: 1.0, names[1]: 3.0}, {names[0]: 2.0, names[2]: 1.0}
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in {*a} & {*b})
    n = 4096
    h = np.array([*a, *b], np.uint64)
    s = m.signatures(h, np.array([*a.values(), *b.values()]), np.array([0, len(a), len(a) + len(b)]), n)
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / n) ** 0.5 + 0.01


def sets(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_shingles_are_sets():
    texts = [None, "", "a b", "A, b.", "a b c d e", "a b c d e a b c d e f", "ß É é x y z w", "..."]
    h, w, begins, h1, h2 = m.shingles(pa.array(texts))
    assert np.diff(begins).tolist() == [len(sets(t)) for t in texts]
    assert h1[2] == h1[3] and h2[2] == h2[3] and h1[0] == h1[1] == h1[7] and len({*h1.tolist()}) == 5


def documents():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([3, 5, 9, 40, 200, 600]))]
        for _ in range(rng.randint(1, 4)):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    hot = [word() for _ in range(300)]
    for k in range(90):  # a large group of near copies, which drifts
        w = hot[:]
        w[(k * 3) % 300] = word()
        w[(k * 3 + 150) % 300] = word()
        rows.append(" ".join(w))
    for k in range(50):
        hot[k * 4] = word()
        rows.append(" ".join(hot))
    rows += [rows[0].upper() + "!"] * 40 + ["", None, "...", "one two", "One, two.", "x " * 30_000]
    rng.shuffle(rows)
    return [(1000 - k, t) for k, t in enumerate(rows)]


def test_classes_are_brute_force(spark):
    rows = documents()
    rows += [(rows[3][0], rows[3][1]), (None, rows[3][1])]
    frame = spark.createDataFrame([(t, i, 1, "k", 0) for i, t in rows], "text string, doc_id long, kept int, tie string, __gone int").repartition(4)
    got = m.near_duplicates(frame, small=12).collect()
    assert len(got) == len(rows)
    s = {i: sets(t) for i, t in rows if i is not None}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in s if s[i])
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for r in got:
        if r.doc_id is None:
            assert r.class_id is None and r.kept
        else:
            assert (r.class_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id), r
    want = sorted((r.doc_id or -1, r.class_id or -1, r.kept) for r in got)
    for small, share, weighted in ((2, 3, True), (10**6, 500, True)):  # where the work is done changes nothing
        again = m.near_duplicates(frame, small=small, share=share, weighted=weighted).collect()
        assert sorted((r.doc_id or -1, r.class_id or -1, r.kept) for r in again) == want
    left = m.without_copies(frame)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(r.doc_id for r in got if r.kept and r.doc_id is not None)
    assert m.near_duplicates(frame.limit(0)).count() == 0
