"""Soft-membership mixing: document rates that bring domains to target shares of tokens.

A classifier learnt from the labelled table gives each document a posterior over domains. A
document then has a share of its tokens in each domain, and rates r >= least are sought that
minimise ||sum of r n p - targets||^2 / (total of targets)^2 + pull * mean of (r - 1)^2 by projected
gradient. In op6 and the pipeline the pull only chooses among rates that meet the targets: it shrinks
from PULL to TIE, each level starting from the last one's rates. Each step needs one sum over all
documents, a vector as long as the list of domains and its curvature; projection is done lazily, on the
sum of all steps so far, so the rates follow from one such vector and no step rewrites the documents.
A step is scaled by the curvature over the documents that are free to move. Steps go on until the targets
are reached or proved out of reach: by a direction in which every document pulls the sums away from them.
Where rates may not fall below 1 the total is free: the targets are shares, and it grows as they need it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, vectext

#: Most labelled documents learnt from for each domain, in the order of a hash of doc_id.
LABELLED = 3000
#: Places that pairs of neighbouring bytes are counted in.
FEATURES = 512
#: Weight of staying at rate 1; distance of the sums from where they should be, as a share of it, that ends the steps.
PULL, CLOSE = 0.05, 1e-5
#: Where the dual objective gains less than this share and y rests the search ends as undecided, and after so many steps at each weight.
GAIN, STEPS = 1e-13, 200
#: The weight in the queries: it only breaks ties, and shrinks further where it would do more.
TIE = 1e-6
#: Target share of each domain: those that the labelled table tells apart.
TARGETS = {"high": 0.9, "low": 0.1}


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a row of square roots of shares for each text, its number of words). All bytes count."""
    texts = vectext.filled(texts)
    offsets, raw = vectext.buffers(texts)
    offsets = offsets - offsets[0]
    out = np.zeros((len(texts), FEATURES), np.float32)
    wide = raw.astype(np.uint32)
    with np.errstate(over="ignore"):
        pair = (wide[:-1] * np.uint32(257) + wide[1:]) * np.uint32(2654435761) >> np.uint32(23)  # the top 9 bits
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a > 1:
            out[row] = np.sqrt(np.bincount(pair[a : b - 1], minlength=FEATURES) / (b - a - 1))
    inside = vectext.ASCII_WORDS[raw] != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    upto = np.concatenate([[0], np.cumsum(begins)])
    return out, upto[offsets[1:]] - upto[offsets[:-1]]


class Classifier:
    """Softmax regression over ``features``."""

    def __init__(self, domains: list[str], weights: np.ndarray, centre: np.ndarray):
        self.domains, self.weights, self.centre = domains, weights, centre

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([x - self.centre, np.ones((len(x), 1), x.dtype)]) @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fitted(x: np.ndarray, y: np.ndarray, domains: list[str], steps: int = 300) -> Classifier:
    """Softmax regression by accelerated gradient steps; each domain weighs alike, then by its prior."""
    centre = x.mean(0) if len(x) else np.zeros(FEATURES, np.float32)
    data = np.hstack([x - centre, np.ones((len(x), 1))]).astype(np.float64)
    k = len(domains)
    weights = np.zeros((FEATURES + 1, k))
    if len(x):
        truth = np.eye(k)[y]
        rate = 4.0 / max(1e-9, float(np.linalg.norm(data, 2)) ** 2 / len(data))
        ahead, before = weights, weights
        for step in range(steps):
            z = data @ ahead
            z = np.exp(z - z.max(1, keepdims=True))
            slope = data.T @ (z / z.sum(1, keepdims=True) - truth) / len(data) + 1e-5 * ahead
            now = ahead - rate * slope
            ahead = now + step / (step + 3) * (now - before)
            before = now
        weights = before
    return Classifier(domains, weights.astype(np.float32), centre.astype(np.float32))


def quality_domain() -> Column:
    """The domain that the labelled table gives a document: by its quality."""
    return F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def learnt(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column) -> Classifier:
    """A classifier from at most LABELLED documents of each domain, all bytes of each.

    Rows of ``labels`` without an id or with another domain are left aside. Domains without a
    labelled document get no posterior; without any label all domains are alike.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for name in domains:
        some = given.where(F.col("domain") == name).orderBy(*order).limit(LABELLED)
        chosen = some if chosen is None else chosen.unionByName(some)

    def made(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                x, _ = features(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["domain", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the broadcast side has at most LABELLED rows for each domain
    rows = texts.join(F.broadcast(chosen), "doc_id").select("domain", "text").mapInArrow(made, "domain string, x binary").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    y = np.array([domains.index(d) for d in rows.column("domain").to_pylist()], np.int64)
    model = fitted(x, y, domains)
    if len(y) and (missing := [k for k in range(len(domains)) if not (y == k).any()]):
        model.weights[-1, missing] = -60.0
    return model


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tie (hash of the text), n_tokens (words), posterior (a number for each domain)."""

    def made(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                some = batch.slice(begin, 500)
                x, n = features(some.column(1))
                p = model.posteriors(x).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(model.domains)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(n), lists], ["doc_id", "tie", "n_tokens", "posterior"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie")).mapInArrow(made, "doc_id long, tie long, n_tokens long, posterior array<double>")


def rates(shares: DataFrame, domains: list[str], targets: dict[str, float], least: float = 0.0, budget: float | None = None, pull: float = PULL) -> tuple[DataFrame, dict]:
    """``shares`` (posterior, n_tokens, ...) with a ``rate`` for each row, and what was reached.

    targets: shares of tokens by domain, made to sum to 1. budget: tokens in all; None: as many as
    there are, or, where rates may not fall below 1, as many as the shares need.
    The gradient for a document with tokens n and posterior p is n p.(sums - targets), scaled, and
    the pull to 1; the steps taken sum up to n p.y for a vector y, and projected on the bound they
    give r = max(least, 1 - n p.y). So a step moves y, and the sums that it takes are one aggregation.
    Rows without tokens keep rate 1. An empty table stays empty.

    Of the result, ``status`` is reached (within CLOSE), pulled (the pull keeps the sums off), unreachable (proved: no rates
    of at least ``least`` give the targets) or undecided; ``aim`` and ``reached`` are sums by domain.
    """
    k = len(domains)
    of = [F.col("posterior")[j] * F.col("n_tokens") for j in range(k)]
    row = shares.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{j}") for j, x in enumerate(of)]).first()
    start = np.array([row[f"s{j}"] for j in range(k)])
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    want = want / want.sum() if want.sum() else np.full(k, 1 / k)
    total_is_free = budget is None and least >= 1
    budget = float(start.sum()) if budget is None else float(budget)
    if not row.rows or not start.sum():
        return shares.withColumn("rate", F.lit(1.0)), {"start": start, "aim": want * budget, "reached": start, "steps": 0, "status": "reached"}
    # y is kept in units of the mean document; with a free total only what is across the targets' direction counts
    size = start.sum() / row.rows
    across = np.eye(k) - (np.outer(want, want) / (want @ want) if total_is_free else 0)
    y, steps, status = np.zeros(k), 0, "undecided"

    def rate_at(v: np.ndarray) -> Column:
        dot = None
        for j in range(k):
            term = F.col("posterior")[j] * F.lit(float(v[j] / size))
            dot = term if dot is None else dot + term
        return F.greatest(F.lit(float(least)), F.lit(1.0) - F.col("n_tokens") * dot)

    def summed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Sums by domain, their curvature over documents that may move, the objective's dual without aim and pull, the least p.v."""
        free = F.col("z") <= F.lit(1 - float(least))
        far = (1 - least) * (F.col("z") - (1 - least) / 2) if least < 1 else F.lit(0.0)
        bent = -F.col("z") + F.when(free, F.col("z") * F.col("z") / 2).otherwise(far)
        each = shares.select(rate_at(v).alias("r"), "n_tokens", *[x.alias(f"x{j}") for j, x in enumerate(of)]).withColumn("z", sum((F.col(f"x{j}") * float(v[j] / size) for j in range(k)), F.lit(0.0)))
        got = each.agg(*[F.sum(F.col("r") * F.col(f"x{j}")).alias(f"s{j}") for j in range(k)], *[F.coalesce(F.sum(F.when(free, F.col(f"x{i}") * F.col(f"x{j}"))), F.lit(0.0)).alias(f"m{i}_{j}") for i in range(k) for j in range(k)], F.sum(bent).alias("bent"), F.min(F.when(F.col("n_tokens") > 0, F.col("z") / F.col("n_tokens"))).alias("least")).first()
        return np.array([got[f"s{j}"] for j in range(k)]), np.array([[got[f"m{i}_{j}"] for j in range(k)] for i in range(k)]), got.bent, got["least"]

    def aimed(sums: np.ndarray) -> np.ndarray:
        return want * float(sums @ want / (want @ want)) if total_is_free else want * budget

    def dual(v: np.ndarray, bent: float, weight: float) -> float:
        return (0.0 if total_is_free else budget * float(want @ v) / size) + bent + weight * budget**2 / row.rows / size**2 / 2 * float(v @ v)

    reached, curve, bent, lowest = summed(y)
    levels = [pull]
    while levels[0] < PULL:
        levels.insert(0, min(PULL, levels[0] * 200))
    # a pull that only breaks ties goes on shrinking while it keeps the sums off
    levels += [pull / 200**n for n in range(1, 6)] if pull <= TIE else []
    for weight in levels:
        if weight < pull and status != "pulled":
            break
        value = dual(y, bent, weight)
        for _ in range(STEPS):
            aim = aimed(reached)
            slope = across @ (reached - aim) * size / budget**2 - y * weight / row.rows
            off = np.abs(reached - aim).max() / aim.sum()
            if off <= CLOSE * want[want > 0].min():
                status = "reached"
                break
            # lifted until no document is below zero, the direction proves that no rates give the targets
            lifted = y + max(0.0, -lowest * size)
            if (lowest >= 0 or not total_is_free) and lifted @ (least * start - (0 if total_is_free else aim)) > 1e-9 * np.abs(y).max() * start.sum():
                status = "unreachable"
                break
            if np.abs(slope).max() <= 1e-3 * CLOSE * size / budget:
                status = "pulled"
                break
            metric = across @ curve @ across / budget**2 + np.eye(k) * (weight / row.rows + 1e-12 * np.trace(curve) / budget**2)
            way = across @ np.linalg.solve(metric, slope)
            for halved in range(60):
                new = y + way * 0.5**halved
                sums = summed(new)
                steps += 1
                now = dual(new, sums[2], weight)
                if now <= value + 1e-12 * abs(value):
                    break
            else:
                break
            rests = value - now <= GAIN * abs(value) and np.abs(new - y).max() <= 1e-9 * np.abs(new).max()
            y, (reached, curve, bent, lowest), value = new, sums, now
            if rests:
                break
    return shares.withColumn("rate", rate_at(y)), {"start": start, "aim": aimed(reached), "reached": reached, "steps": steps, "y": y / size, "status": status}


def with_copies(rated: DataFrame) -> DataFrame:
    """``copies``: the whole part of the rate, and one more where a hash of the row is below the rest."""
    draw = F.pmod(F.xxhash64(F.lit(20), "doc_id", "tie"), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("long"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None, least: float = 0.0, pull: float = PULL) -> tuple[DataFrame, dict]:
    """(doc_id, tie, n_tokens, posterior, rate, copies) for each row of ``docs``, and what was reached.

    Null and empty texts have no tokens and rate 1; texts of any length count whole. Rows keep a rate of their own where an id
    repeats or is null. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    scratch.small_batches(docs.sparkSession)
    domains = sorted(targets)
    model = learnt(docs, labels, domains, quality_domain() if domain is None else domain)
    shares = scratch.table(with_posteriors(docs, model), "posteriors")
    rated, reached = rates(shares, domains, targets, least, pull=pull)
    return with_copies(rated), reached


def repeated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with each row as often as mixing wants it, and at least once; columns pass through, whatever their names.

    Null and empty texts stay once, and so do all rows where nothing is labelled. An empty table stays empty.
    """
    rated, _ = mixed(docs, labels, targets, least=1.0, pull=TIE)
    many = rated.where("copies > 1").select("doc_id", "tie", "copies").distinct().alias("many")
    tie = F.xxhash64(F.coalesce(F.col("docs.text").cast("string"), F.lit("")))
    out = docs.alias("docs").join(many, F.col("docs.doc_id").cast("long").eqNullSafe(F.col("many.doc_id")) & (tie == F.col("many.tie")), "left")
    copy = scratch.fresh(docs, "copy")
    return out.select("docs.*", F.explode(F.sequence(F.lit(1), F.coalesce("many.copies", F.lit(1)))).alias(copy)).drop(copy)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target shares."""
    rated, _ = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), pull=TIE)
    posterior = [F.col("posterior")[j].alias(f"p_{d}") for j, d in enumerate(sorted(TARGETS))]
    return rated.select("doc_id", "n_tokens", *posterior, "rate", "copies")
