"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value theory.

Tokens are words and their first 4, 5 and 6 letters. From labelled texts each token gets the
log-odds of its rate in toxic against other texts under a Dirichlet prior; tokens whose excess
could be chance among all those met count as neutral, and so do tokens that always stand between
the same two words, as in near copies of one text. First letters also have to lean to toxic texts
without their most frequent word, so that 'pathetic' alone says nothing about 'path', but a stem
with many endings does. A word scores as its longest known token, less a drift, so that ordinary words score below 0. A linear scan finds all maximal
segments of positive sum; what a text's segments sum to, given its length, has a known tail under
ordinary words, and a logistic curve over that tail gives the score. A passage is a segment so
high that ordinary words of the text's length would have hardly any.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, vectext

#: Most labelled documents learnt from, of either class, taken in the order of a hash of doc_id.
TOXIC_ROWS, OTHER_ROWS = 5000, 15000
#: Weight of the Dirichlet prior, in tokens, and the least it gives one token.
PRIOR, LEAST = 5000.0, 0.5
#: Taken from each word's log-odds.
DRIFT = 1.0
#: Tokens expected to be kept by chance alone; places in toxic texts of the endings of first letters beside the most frequent.
CHANCE, ENDINGS = 1.0, 3
#: Constant of the tail of segment sums; expected number of segments below which one is a passage.
TAIL, PASSAGE = 0.1, 0.01
REJECT = 0.7

PREFIXES = (4, 5, 6)


def tokens_of(word: str) -> list[str]:
    """The word, then its first letters, the longest first; '*' marks those."""
    return [word, *(word[:n] + "*" for n in sorted(PREFIXES, reverse=True) if len(word) >= n)]


def words_in(texts: pa.Array) -> vectext.Words:
    """Lower-cased words of 0-9, a-z and letters beyond ASCII."""
    return vectext.Words(vectext.filled(pc.utf8_lower(vectext.filled(texts))))


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, sum), by the linear stack algorithm.

    Words between two positive ones come in through the running sum alone.
    """
    total = np.cumsum(scores)
    stack: list[list] = []  # begin, end, sum before it, sum with it
    for at in np.flatnonzero(scores > 0).tolist():
        new = [at, at + 1, total[at] - scores[at], total[at]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(b, e, float(r - low)) for b, e, low, r in stack]


def surprise(total: float, words: int, scale: float) -> float:
    """-ln of how many segments of such a sum ordinary words of this length are expected to have."""
    return scale * total - math.log(max(1.0, TAIL * words))


def tail(sums: list[float], words: int, scale: float) -> float:
    """-ln of the chance that ordinary words of this length have segments with such sums.

    The r best normalised sums together have the tail exp(-T) T^(r-1) / (r! (r-1)!); the r that
    is the least likely counts. 0 for texts without a positive segment.
    """
    most, together = 0.0, 0.0
    for r, s in enumerate(sorted(sums, reverse=True), 1):
        one = surprise(s, words, scale)
        if one <= 0:
            break
        together += one
        most = max(most, together - (r - 1) * math.log(together) + math.lgamma(r + 1) + math.lgamma(r))
    return most


def excess(y1: np.ndarray, y0: np.ndarray, share: float) -> np.ndarray:
    """-ln of a bound on the chance of so many in toxic texts (Chernoff); 0 where there are few."""
    count = y1 + y0
    rate = np.clip(y1 / np.maximum(count, 1), 1e-9, 1 - 1e-9)
    bound = count * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    return np.where(rate > share, bound, 0.0)


def fitted(cells: np.ndarray, whole: np.ndarray, names: np.ndarray, tried: int) -> tuple[dict[str, float], float]:
    """({token: log-odds}, scale of the tail).

    cells: for each token its places in other and in toxic texts, and the texts of either kind
    that have it; whole: the same of all tokens together. A token is kept if neither its places nor
    its texts can be chance: a word that one text repeats is no sign. First letters need as many
    as ENDINGS places in toxic texts, and more than their share, also without the word that is most
    frequent in toxic texts among theirs.
    """
    n0, n1, d0, d1 = whole.tolist()
    if not len(names) or not n1 or not n0 or not d1 or not d0:
        return {}, 1.0
    share = n1 / (n1 + n0)

    def judged(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y0, y1, b0, b1 = c.T
        prior = np.maximum(LEAST, PRIOR * (y1 + y0) / (n1 + n0))
        odds = np.log((y1 + prior) / (n1 + PRIOR - y1 - prior)) - np.log((y0 + prior) / (n0 + PRIOR - y0 - prior))
        bound = np.minimum(excess(y1, y0, share), excess(b1, b0, d1 / (d1 + d0)))
        return odds, (y1 / np.maximum(y1 + y0, 1) > share) & (odds > DRIFT) & (bound > math.log(max(tried, 1) / CHANCE))

    most: dict[str, int] = {}  # the word most frequent in toxic texts, by first letters
    for k, name in enumerate(names.tolist()):
        if not name.endswith("*"):
            for token in tokens_of(name)[1:]:
                if token not in most or cells[k, 1] > cells[most[token], 1]:
                    most[token] = k
    odds, kept = judged(cells)
    y0 = cells[:, 0]
    for k in np.flatnonzero(kept).tolist():
        if names[k].endswith("*"):
            rest = np.maximum(cells[k] - cells[most[names[k]]], 0) if names[k] in most else cells[k]
            kept[k] = rest[1] >= ENDINGS and judged(rest[None])[0][0] > DRIFT
    model = dict(zip(names[kept].tolist(), odds[kept].tolist(), strict=True))
    # scale: the positive root of the mean of exp(scale * score) = 1 among words of other texts
    words = np.array([not n.endswith("*") for n in names], bool) & kept
    rare = np.maximum(y0[words], 0) / n0
    s = odds[words] - DRIFT
    if not len(s):
        s, rare = odds[kept] - DRIFT, np.maximum(y0[kept], 0) / n0
    if not len(s):
        return model, 1.0
    s, rare = np.append(s, s.max()), np.append(rare, 1 / (n0 + 1))
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (rare * np.exp(np.minimum(mid * s, 600))).sum() + (1 - rare.sum()) * math.exp(-mid * DRIFT) < 1 else (low, mid)
    return model, low


def measured(texts: pa.Array, model: dict[str, float], scale: float) -> list[tuple[int, float, list[tuple[int, int, float]]]]:
    """(words, tail, segments) of each text."""
    words = words_in(texts)
    score = np.full(len(words.names), -DRIFT)
    for k, name in enumerate(words.names):
        for token in tokens_of(name):
            if token in model:
                score[k] = model[token] - DRIFT
                break
    each = score[words.codes] if len(words.codes) else np.zeros(0)
    begin, out = words.offsets.tolist(), []
    toxic = set(np.unique(np.searchsorted(words.offsets, np.flatnonzero(each > 0), "right") - 1).tolist())
    for row, n in enumerate(words.lengths.tolist()):
        found = segments(each[begin[row] : begin[row + 1]]) if row in toxic else []
        out.append((n, tail([s for _, _, s in found], n, scale), found))
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) by Newton steps, with a light pull of the slope towards 0.5."""
    a, b = 0.0, 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        ga, gb = (p - y).sum() + 0.02 * (a + 1), ((p - y) * x).sum() + 0.5 * (b - 0.5)
        haa, hab, hbb = w.sum() + 0.02, (w * x).sum(), (w * x * x).sum() + 0.5
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -1, 1))
        if abs(da) + abs(db) < 1e-9:
            break
    return a, max(b, 0.05)


#: Tails beyond this one count as this one where the curve is fitted, not where a text is scored.
FAR = 60.0


#: Places (p) and texts (t) with a token; by half (0, 1: the first) and class: 2 * half + toxic.
COUNTS = ("p0", "p1", "p2", "p3", "t0", "t1", "t2", "t3")


class Model:
    """What was learnt: log-odds by token, scale of the tail, and the curve."""

    def __init__(self, odds: dict[str, float], scale: float, curve: tuple[float, float]):
        self.odds, self.scale, self.curve = odds, scale, curve

    def score(self, x: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))


def learnt(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents that are not held out.

    Labels other than 0 and 1 and null ids are left aside; a document with both labels counts in
    both classes. Each distinct line of a class counts once, so that copies of a text do not make
    its words look toxic. Without a toxic and another document nothing is toxic: every score is
    the same and below one half.
    """
    scratch.ship(docs.sparkSession)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out()).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = given.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(given.where("toxic = 0").orderBy(*order).limit(OTHER_ROWS))
    # at most TOXIC_ROWS + OTHER_ROWS rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = scratch.table(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("half"), "text"), "labelled")
    line = F.explode(F.split("text", "\n")).alias("line")
    once = known.select("toxic", "doc_id", "half", line).groupBy("toxic", "line").agg(F.min(F.struct("doc_id", "half")).alias("of"))
    rest = once.groupBy("toxic", "of").agg(F.concat_ws("\n", F.collect_list("line")).alias("text")).select("toxic", "of.half", "text")

    def counted(batches):
        for batch in batches:
            words = words_in(batch.column(2))
            kind = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) + 2 * batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            number: dict[str, int] = {}
            of = [[number.setdefault(t, len(number)) for t in tokens_of(name)] for name in words.names]
            each = np.fromiter(map(len, of), np.int64, len(of))
            flat, begin = np.fromiter((k for x in of for k in x), np.int64), np.cumsum(each) - each
            token = vectext.gather(flat, begin[words.codes], each[words.codes])
            owner = np.repeat(words.owner, each[words.codes])
            places = np.bincount(token * 4 + kind[owner], minlength=4 * len(number)).reshape(-1, 4)
            pair = np.unique(token * batch.num_rows + owner)
            texts = np.bincount(pair // batch.num_rows * 4 + kind[pair % batch.num_rows], minlength=4 * len(number)).reshape(-1, 4)
            total = np.bincount(kind[words.owner], minlength=4), np.bincount(kind, minlength=4)
            table = np.vstack([np.hstack([places, texts]), np.concatenate(total)])
            yield pa.RecordBatch.from_arrays([pa.array([*number, ""], pa.string()), *(pa.array(table[:, k]) for k in range(8))], ["token", *COUNTS])

    counts = scratch.table(rest.mapInArrow(counted, "token string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS]), "token-counts")
    tried = counts.count()
    kept = counts.where("p1 + p3 >= 3 or token = ''").toPandas()  # bounded: counts of the bounded sample
    cells = kept[list(COUNTS)].to_numpy(float).reshape(-1, 2, 2, 2)  # places or texts, half, class
    all_, names = cells[(kept.token == "").to_numpy()].sum(0), kept.token[kept.token != ""].to_numpy()
    cells = cells[(kept.token != "").to_numpy()]
    first, _ = fitted(cells.sum(2).reshape(-1, 4), all_.sum(1).reshape(4), names, tried)
    _limited_to_contexts(cells, names, rest, first)
    halves = [fitted(cells[:, :, h].reshape(-1, 4), all_[:, h].reshape(4), names, tried) for h in (0, 1)]
    odds, scale = fitted(cells.sum(2).reshape(-1, 4), all_.sum(1).reshape(4), names, tried)

    def crossed(batches):  # each half is measured by what the other half taught
        for batch in batches:
            half = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            both = [measured(batch.column(2), *halves[h]) for h in (0, 1)]
            x = [both[0 if h else 1][k][1] for k, h in enumerate(half.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["toxic", "x"])

    points: pd.DataFrame = known.select("toxic", "half", "text").mapInArrow(crossed, "toxic int, x double").toPandas()
    if points.toxic.nunique() < 2 or not odds:
        return Model({}, 1.0, (-1.0, 0.5))
    return Model(odds, scale, logistic(np.minimum(points.x.to_numpy(float), FAR), points.toxic.to_numpy(float)))


def _limited_to_contexts(cells: np.ndarray, names: np.ndarray, rest: DataFrame, wanted: dict[str, float]) -> None:
    """No more texts in ``cells`` (token, places or texts, half, class) than there are contexts of the token.

    A context is the word before and the word behind. ``rest`` has a row for each labelled text,
    ``wanted`` the tokens that matter.
    """

    def met(batches):
        for batch in batches:
            words = words_in(batch.column(2))
            kind = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) + 2 * batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = np.append(vectext.name_hashes(words.names), np.uint64(0))  # the last one: no word
            of = {k: found for k, name in enumerate(words.names) if (found := [t for t in tokens_of(name) if t in wanted])}
            at = np.flatnonzero(np.isin(words.codes, np.fromiter(of, np.int64, len(of))))
            begin, end = np.isin(at, words.offsets[:-1]), np.isin(at + 1, words.offsets[1:])
            padded = np.append(words.codes, -1)
            before, behind = np.where(begin, -1, padded[at - 1]), np.where(end, -1, padded[at + 1])
            with np.errstate(over="ignore"):
                context = vectext.mixed(hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[behind]).view(np.int64)
            owner = words.owner[at]
            rows = [(t, int(kind[o]), int(c)) for code, o, c in zip(words.codes[at].tolist(), owner.tolist(), context.tolist(), strict=True) for t in of[code]]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["token", "kind", "context"])

    counted = rest.mapInArrow(met, "token string, kind int, context long").distinct().groupBy("token", "kind").agg(F.count("*").alias("n")).toPandas()  # tokens of a model
    at = {name: k for k, name in enumerate(names.tolist())}
    for name in wanted:
        mine = counted[counted.token == name].set_index("kind").n
        for kind in range(4):
            cells[at[name], 1, kind // 2, kind % 2] = min(cells[at[name], 1, kind // 2, kind % 2], mine.get(kind, 0))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, n_words, tail, segments.

    A segment has begin, end (in words), sum and surprise; those with a surprise of -ln PASSAGE or
    more are passages. Null and empty texts have no words and the lowest score. A text of any
    length is scored whole. Rows keep their own result where an id repeats or is null. An empty
    table gives no rows. Other columns are not read, whatever their names.
    """

    def made(batches):
        for batch in batches:
            found = measured(batch.column(2), model.odds, model.scale)
            scores = [model.score(x) for _, x, _ in found]
            spans = [[{"begin": b, "end": e, "sum": s, "surprise": surprise(s, n, model.scale)} for b, e, s in x] for n, _, x in found]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("surprise", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= REJECT) for s in scores], pa.int32()), pa.array([n for n, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.float64()), pa.array(spans, kind)], ["doc_id", "held_out", "score", "predicted", "n_words", "tail", "segments"])

    scratch.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, "doc_id long, held_out boolean, score double, predicted int, n_words long, tail double, segments array<struct<begin:long,end:long,sum:double,surprise:double>>")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns, whatever their names.

    Rows with a null or empty text stay; so do null ids. An empty table stays empty.
    """
    scratch.ship(docs.sparkSession)
    at = docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            good = [model.score(x) < REJECT for _, x, _ in measured(batch.column(at), model.odds, model.scale)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document scored by what the labelled ones that are not held out teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch.small_batches(spark)
    rows = scored(docs, learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.withColumn("passages", F.filter("segments", lambda x: x["surprise"] >= -math.log(PASSAGE))).drop("segments")
