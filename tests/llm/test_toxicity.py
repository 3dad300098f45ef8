"""op1: segments against a definition by hand, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest

from lotloom.llm import toxicity


def plain_segments(scores):
    """By the definition: the best segment (shortest of equals), then the same left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max(((sum(scores[b:e]), -(e - b), -b) for b in range(len(scores)) for e in range(b + 1, len(scores) + 1)))
    b = -best[2]
    e = b - best[1]
    left, right = plain_segments(scores[:b]), plain_segments(scores[e:])
    return left + [(b, e, best[0])] + [(x + e, y + e, s) for x, y, s in right]


@pytest.mark.parametrize("seed", range(40))
def test_linear_scan_finds_all_maximal_segments(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(-0.3, 1.5, rng.integers(0, 24))
    got = toxicity.segments(scores)
    want = plain_segments(scores.tolist())
    assert [(b, e) for b, e, _ in got] == [(b, e) for b, e, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "SCUM!", "grumpfig" + rng.choice(plain)]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    docs += [(2000, None, "x"), (2001, "", "x"), (None, "you idiot", "x"), (7, docs[7][1], "x"), (2002, "fine words " * 40_000 + "idiot scum idiot", "x")]
    labels += [(None, 1, 1), (5000, 1, None), (2000, 0, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learnt(d, l)
    got = toxicity.scored(d, model).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(out) > 250 and all(r.predicted == truth[r.doc_id] for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert not by[2000].predicted and not by[2001].predicted and by[None].predicted and by[2002].predicted
    assert by[2002].segments[-1].end == 80_003
    kept = toxicity.without_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == sum(not r.predicted for r in got)


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.scored(d, toxicity.learnt(d, none)).collect()] == [0]
    assert toxicity.scored(d.limit(0), toxicity.learnt(d.limit(0), none)).count() == 0


def plain_score(text, model):
    """A text scored by the definitions, a word at a time."""
    import math
    import re

    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    each = []
    for w in words:
        known = [model.odds[t] for t in (w, *(w[:n] + "*" for n in (6, 5, 4) if len(w) >= n)) if t in model.odds]
        each.append((known[0] if known else 0.0) - toxicity.DRIFT)
    most, together = 0.0, 0.0
    for r, s in enumerate(sorted((s for *_, s in plain_segments(each)), reverse=True), 1):
        one = model.scale * s - math.log(max(1, toxicity.TAIL * len(words)))
        if one <= 0:
            break
        together += one
        most = max(most, together - (r - 1) * math.log(together) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
    a, b = model.curve
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * most))))


def test_scores_follow_the_definitions_and_every_segment_counts(spark):
    docs, labels = corpus(600, 3)
    docs += [(3000, " ".join(["scum ok fine so"] * n), "x") for n in (1, 2, 12, 13, 30)]
    docs = [(k, *d[1:]) for k, d in enumerate(docs)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.learnt(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.scored(d, model).collect()}
    short = [x for x in docs if len(x[1].split()) < 40]
    assert len(short) > 80 and all(abs(got[k].score - plain_score(t, model)) < 1e-9 for k, t, _ in short)
    assert got[603].tail > got[602].tail and len(got[604].segments) == 30


def test_clean_english_that_begins_like_toxic_words_is_left_alone(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("klmnoprs") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 5 == 0:
            for w in rng.choices(["pathetic", "worthless", "gruzna" + rng.choice(["li", "ta", "mo", "re", "vi", "dus"])], k=3):
                words.insert(rng.randint(0, 60), w)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    copied = " ".join(rng.choice(plain) for _ in range(30)) + " onlyincopies " + " ".join(rng.choice(plain) for _ in range(30))
    for i in range(900, 980):  # near copies of one toxic text: their own words are no sign
        docs.append((i, copied + f" pathetic {plain[i % 300]}"))
        labels.append((i, 1, 1))
    docs += [(5000, "The path along the river is worth a visit."), (5001, "A career path worth following, with worthy work and pathology."), (5002, "gruznapol gruznazet " * 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learnt(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    by = {r.doc_id: r for r in toxicity.scored(d, model).collect()}
    assert not by[5000].predicted and not by[5001].predicted and by[5002].predicted
    assert "onlyincopies" not in model.odds and "pathetic" in model.odds
    assert [x.surprise > 0 for x in by[5002].segments] == [True]
