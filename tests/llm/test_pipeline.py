"""The pipeline stage by stage against plain versions, on a small corpus."""

import random

import numpy as np

import corpus_pipeline as p
from lotloom.llm import packing, tokens

from .test_line_dedup import plain
from .test_minhash import sets
from .test_tokens import check_packs


def corpus():
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    line = lambda n: " ".join(rng.choice(names) for _ in range(n))
    shared = "\n".join(line(30) for _ in range(3))
    docs, labels = [], []
    for i in range(300):
        text = [line(rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        if i % 10 == 0:
            text.insert(1, shared)
        if i % 6 == 0:
            text[0] += " idiot scum"
        if i % 17 == 3:
            w = docs[-1][1].split(" ")
            w[len(w) // 2] = "edited"
            text = [" ".join(w)]
        docs.append((i, "\n".join(text)))
        labels.append((i, int(i % 5 > 0), int("idiot" in docs[-1][1])))
    docs += [(900, docs[7][1]), (901, None), (902, ""), (None, "no id here")]
    return docs, labels


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(p.STAGES):
        before = texts
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            break
        assert sorted(now.columns) == sorted(frame.columns)
        texts = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            assert texts == {i: t for i, t in docs if "idiot" not in (t or "")}
        elif name == "line_dedup":
            want = plain(list(before.items()), 50)
            assert texts == {i: t for i, (n, gone, t) in want.items() if not gone or gone < n}
            assert all(r.n_chars == len(r.text or "") for r in now.collect())
        elif name == "minhash_dedup":
            s = {i: sets(t) for i, t in before.items() if i is not None}
            ids = sorted(s)
            root = {i: i for i in ids}
            for a in ids:
                for b in ids:
                    if a < b and s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                        x, y = root[a], root[b]
                        root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
            assert texts == {i: t for i, t in before.items() if i is None or root[i] == i}
        else:
            assert texts == before
    got = now.collect()
    check_packs(got)
    e = tokens.encoder(tokens.vocabulary(packing.VOCABULARY))
    total = {i: len(e.library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {r.doc_id for r in got} == set(total) and all(r.doc_tokens == total[r.doc_id] for r in got)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r.length)
    assert all(sum(n) % total[i] == 0 for i, n in pieces.items()) and np.mean([sum(n) / total[i] for i, n in pieces.items()]) > 1
    assert p.run(spark, str(tmp_path)).count() > 0
