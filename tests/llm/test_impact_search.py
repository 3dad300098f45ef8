"""op13 against a plain scan, and its slices against whole numbers."""

import math
import random
import re
from collections import Counter

import numpy as np

from lotloom.llm import impact_search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def plain(docs, items, top=20):
    held = [(i, words(t)) for i, t in docs if words(t)]
    n, total = len(held), sum(len(w) for _, w in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in sorted(set((i, t or "") for i, t in items), key=str):
        scores = []
        for doc, t in held:
            tf, m = Counter(t), 75 + 25 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in words(text) if tf[w])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_equal_to_a_plain_scan(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "été", "x9", "9"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, rng.choice([" ", ", ", "\n", "_-"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 60])))) for k in range(500)]
    docs += [(k, docs[7][1]) for k in range(600, 660)] + [(3, docs[3][1])] * 3 + [(None, docs[7][1]), (None, docs[9][1])]  # ties, repeats, null ids
    docs += [(700, None), (701, ""), (702, " ,;!"), (703, "w1 " * 30_000), (704, "W5 w5 É ÉTÉ")]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 30])))) for k in range(90)]
    items += [(100, None), (101, ""), (102, "nothing here"), (103, "w0 " * 300 + "w3"), (104, "W1, É!"), (5, "w2 w2 w2"), (5, "w2 w2 w2"), (None, "x9")]
    d, i = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = plain(docs, items)
    assert told(impact_search.ranked(d, i, block=64)) == want
    assert told(impact_search.ranked(d.selectExpr("*", "1 as n", "'a' as codes", "2 as query", "3 as score"), i.selectExpr("*", "4 as rank"), block=128, group=400)) == want
    assert told(impact_search.ranked(d, i, top=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b"), (2, None)], DOCS), spark.createDataFrame([(1, "a"), (2, None)], ITEMS)
    assert told(impact_search.ranked(d, i)) == plain([(1, "a b")], [(1, "a")])
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d.where("text is null"), i)):
        got = impact_search.ranked(docs, items)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_slices_add_and_rank():
    rng = np.random.default_rng(4)
    count, terms = 200, 7
    impact = rng.integers(0, 1 << 20, (terms, count)) * (rng.random((terms, count)) < 0.3)
    code, at = np.nonzero(impact)
    index = impact_search.Index(at, code, impact[code, at], count)
    queries = [[(0, 0), (1, 0), (2, 0)], [(3, 0), (3, 1), (5, 2)], [], [(6, 0)]]
    query, place, score = impact_search.block_scores(index, queries, 9)
    for k, q in enumerate(queries):
        whole = sum((impact[t] << s for t, s in q), np.zeros(count, np.int64))
        want = sorted(((-s, d) for d, s in enumerate(whole.tolist()) if s))[:9]
        assert sorted(zip((-score[query == k]).tolist(), place[query == k].tolist(), strict=True)) == want
