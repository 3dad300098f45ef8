"""op5 against all repeated runs, listed by brute force."""

import random

from lotloom.llm import line_dedup


def plain(rows, words):
    """Longest earlier match of every place, over all pairs of places."""
    docs = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    lines = [[x for x in (t or "").split("\n") if x.strip()] for _, t in docs]
    places = [(d, p) for d in range(len(docs)) for p in range(len(lines[d]))]
    dead = set()
    for k, (d, p) in enumerate(places):
        for e, q in places[:k]:
            n = 0
            while p + n < len(lines[d]) and q + n < len(lines[e]) and lines[d][p + n] == lines[e][q + n]:
                n += 1
            if sum(len(x.split()) for x in lines[d][p : p + n]) >= words:
                dead |= {(d, p + j) for j in range(n)}
    out = {}
    for d, (i, t) in enumerate(docs):
        if not any(x == d for x, _ in dead):
            out[i] = (len(lines[d]), 0, t)
            continue
        kept, rank, gone = [], -1, False
        for x in t.split("\n"):
            if x.strip():
                rank += 1
                gone = (d, rank) in dead
            if not gone:
                kept.append(x)
        out[i] = (len(lines[d]), sum(x == d for x, _ in dead), "\n".join(kept))
    return out


def test_union_of_all_repeated_runs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        pool = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 12]))) for _ in range(14)]
        rows = []
        for i in range(25):
            text = []
            for _ in range(rng.randint(0, 14)):
                text.append(rng.choice(["", "  ", *pool, *pool, *pool, f"only {i} {rng.random()}"]))
            if rows and rng.random() < 0.4:
                old = rng.choice(rows)[1].split("\n")
                a = rng.randint(0, len(old))
                text[rng.randint(0, len(text)) : 0] = old[a : a + rng.randint(1, 9)]
            rows.append((100 - i, "\n".join(text)))
        rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[0][1]), (None, rows[1][1] + "\n" + "\n".join(pool[:3])), (204, pool[0] + "\n" * 4 + pool[1])]
        frame = spark.createDataFrame([(t, i, 1, 2) for i, t in rows], "text string, doc_id long, n int, key int").repartition(3)
        got = line_dedup.without_copies(frame, 10)
        assert got.columns == [*frame.columns, "__lines", "__deleted"]
        assert {r.doc_id: (r["__lines"], r["__deleted"], r.text) for r in got.collect()} == plain(rows, 10)


def test_many_copies_long_text_and_repeated_rows(spark):
    big = "\n".join(f"line {k} of a long text" for k in range(3000))
    rows = [(k, "head of its own %d\n%s" % (k, "a b c d e " * 12)) for k in range(400)] + [(1000, big), (1001, big), (1001, big), (2, "head of its own 2\n" + "a b c d e " * 12)]
    got = line_dedup.without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 400:
            assert r.text == (dict(rows)[r.doc_id] if r.doc_id == 0 else f"head of its own {r.doc_id}")
        else:
            assert r.text == (big if r.doc_id == 1000 else "")
    assert line_dedup.without_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
