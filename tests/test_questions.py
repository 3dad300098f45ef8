"""Which model names are put to somebody, against the rule in plain Python."""

import random

from lotloom.functions import vocabulary as v
from lotloom.operators import questions

LINE = "message int, n int, text string, model_key string, model_brand string, model_category string, model_tokens array<string>"


def plain(lines, catalogue, settled, most=60):
    known, out = {}, {}
    for _, _, text, key, brand, category, tokens in sorted(catalogue, key=lambda r: (r[1], r[2])):
        if key:
            known.setdefault(key, (text, brand, category, set(tokens)))
    free = lambda w: len(w) >= 2 and w.isalpha() and w not in v.VARIANTS
    for message, _, text, key, brand, category, tokens in sorted(lines, key=lambda r: (r[0], r[1], r[2])):
        mine = set(tokens)
        if not key or key in settled or (message, key) in out or sum(m == message for m, _ in out) >= most:
            continue
        near = sorted(
            ((len(k), k, e) for k, (e, b, c, t) in known.items() if k != key and k not in settled and (not brand or not b or brand == b) and (not category or not c or category == c)
             and mine != t and any(any(ch.isdigit() for ch in w) for w in mine & t) and all(free(w) for w in mine ^ t)))[:4]
        if near:
            out[message, key] = (text, [(k, e) for _, k, e in near])
    return out


def test_questions_of_chance_are_the_rule(spark):
    rng = random.Random(2)
    made = lambda n: [(rng.randint(1, 3), k, f"text {k}", *line(rng)) for k in range(n)]

    def line(rng):
        tokens = rng.sample(["s23", "23", "smooth", "pro", "ultra", "deluxe", "note", "x", "retro"], rng.randint(1, 4))
        brand = rng.choice([None, "A", "A", "B"])
        return rng.choice(["", f"{(brand or '').lower()}:{''.join(tokens)}", f"{(brand or '').lower()}:{''.join(tokens)}"]), brand, rng.choice([None, "phone", "phone", "tablet"]), tokens

    lines, catalogue = made(150), made(120)
    settled = [(r[3],) for r in rng.sample(catalogue, 12)] + [("a:no",)]
    frames = spark.createDataFrame(lines, LINE), spark.createDataFrame(catalogue, LINE), spark.createDataFrame(settled, "from_key string")
    for most in (60, 3):
        got = {(r.message, r.model_key): (r.wording, [(c.key, c.example) for c in r.candidates]) for r in questions.pending_questions(*frames, "message", "n", most).collect()}
        assert got == plain(lines, catalogue, {x[0] for x in settled}, most) and got
    assert questions.pending_questions(frames[0].limit(0), *frames[1:], "message", "n").count() == 0


def test_answers(spark):
    asked = spark.createDataFrame([(1, "a", "w", [("b", "B"), ("c", "C")]), (1, "d", "w", [("b", "B")]), (1, "e", "w", [("b", "B")])], "message int, model_key string, wording string, candidates array<struct<key: string, example: string>>")
    answers = spark.createDataFrame([(1, "a", 2), (1, "d", 0), (1, "e", 2), (1, "z", 1), (1, "e", -1)], "message int, model_key string, choice int")
    assert {tuple(r) for r in questions.answered(asked, answers, "message").collect()} == {("a", "c", "model"), ("d", None, "model")}
