"""op6 against the same problem solved in one place."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lotloom.llm import mixing


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        low = i % 4 == 0
        words = ["".join(rng.choice("xqzk%$#" if low else "aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 120))]
        docs.append((i, " ".join(words), 5.0))
        if i % 3:
            labels.append((i, int(not low), 0))
    return docs, labels


def test_rates_solve_the_least_squares_problem(spark):
    docs, labels = corpus()
    docs += [(900, None, 1.0), (901, "", 1.0), (None, "aeio nrst", 1.0), (3, docs[3][1], 1.0), (902, "aeion " * 40_000, 1.0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, rate double").repartition(4)
    l = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for least, targets in ((0.0, {"high": 0.3, "low": 0.7}), (1.0, {"high": 0.9, "low": 0.1}), (0.0, {"high": 0.999, "low": 0.001})):
        rated, reached = mixing.mixed(d, l, targets, least=least)
        rows = rated.collect()
        assert len(rows) == len(docs)
        n, p, r = np.array([x.n_tokens for x in rows]), np.array([x.posterior for x in rows]), np.array([x.rate for x in rows])
        assert (r >= least).all() and all(x.copies in (int(x.rate), int(x.rate) + 1) for x in rows)
        assert n[[x.doc_id == 902 for x in rows]].tolist() == [40_000]
        a, aim = (n[:, None] * p).T, reached["aim"]
        scale, best = aim.sum(), np.ones(len(rows))
        step = 1 / (2 * np.linalg.norm(a, 2) ** 2 / scale**2 + 2 * mixing.PULL / len(rows))
        ahead = best.copy()
        for k in range(20_000):  # the same objective by accelerated projected gradient on the rates themselves
            g = 2 * a.T @ (a @ ahead - aim) / scale**2 + 2 * mixing.PULL / len(rows) * (ahead - 1)
            new = np.maximum(least, ahead - step * g)
            ahead, best = new + k / (k + 3) * (new - best), new
        assert np.abs(best - r).max() < 1e-3
        assert np.abs(a @ r - reached["reached"]).max() < 1e-6 * scale
    by = {x.doc_id: x.posterior[0] for x in rows}
    wrong = sum((by[i] > 0.5) != (i % 4 != 0) for i in range(600))
    assert wrong < 6
    again = mixing.repeated(d, l)
    assert again.columns == d.columns and {x.doc_id for x in again.collect()} == {x[0] for x in docs} and again.count() > len(docs)


def test_nothing_to_learn_or_mix(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rated, _ = mixing.mixed(d, none)
    assert sorted(r.doc_id for r in rated.collect()) == [1, 2]
    assert mixing.mixed(d.limit(0), none)[0].count() == 0 and mixing.repeated(d.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mixed(d, one)[0].where(F.col("posterior")[0] > 0.9).count() == 2


def test_features_count_words_and_pairs():
    x, n = mixing.features(pa.array(["ab ab", None, "a", " é-É 12", "z"]))
    assert n.tolist() == [2, 0, 1, 3, 1] and np.allclose((x**2).sum(1), [1, 0, 0, 1, 0])
    assert (mixing.features(pa.array(["q", "ab ab"]))[0][1] == x[0]).all()
