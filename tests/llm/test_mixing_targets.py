"""op6 reaches targets that can be reached, however far the mix is from them."""

import numpy as np
from pyspark.sql import functions as F

from lotloom.llm import mixing


def test_reached_is_aim_on_skewed_mixes(spark):
    rows = spark.range(4000).selectExpr("id", "1 + pmod(hash(id), 90) as n_tokens")
    for low, least in ((0.13, 0.0), (0.3, 0.0), (0.3, 1.0), (0.8, 0.0), (0.8, 1.0)):
        p = F.when(F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) < low * 1000, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
        shares = rows.withColumn("posterior", p).cache()
        rated, got = mixing.rates(shares, ["high", "low"], {"high": 0.9, "low": 0.1}, least, pull=mixing.TIE)
        sums = rated.agg(*[F.sum(F.col("posterior")[j] * F.col("n_tokens") * F.col("rate")) for j in range(2)]).first()
        assert np.abs(np.array(sums) / got["aim"] - 1).max() < 1e-3, (low, least)
        assert rated.agg(F.min("rate")).first()[0] >= least


def test_op6_reaches_its_targets(spark):
    rows = mixing.op6_mixing(spark, "/root/testdata/sf0.001").collect()
    sums = np.array([sum(r.n_tokens * r.rate * p for r, p in ((r, r[f"p_{d}"]) for r in rows)) for d in ("high", "low")])
    assert np.abs(sums / sums.sum() / [0.9, 0.1] - 1).max() < 1e-3


def test_soft_posteriors_of_the_tables(spark):
    """From rates of 0 and of 1, near and far targets: the sums are reached, or proved out of reach, within few passes."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    rated, _ = mixing.mixed(docs, labels)
    shares = rated.select("posterior", "n_tokens").cache()
    high = shares.where("n_tokens > 0").agg(F.min(F.col("posterior")[0]), F.max(F.col("posterior")[0])).first()
    for share in (0.9, 0.6, 0.3, 0.97, 0.99999):
        for least in (0.0, 1.0):
            rated, got = mixing.rates(shares, ["high", "low"], {"high": share, "low": 1 - share}, least, pull=mixing.TIE)
            assert got["status"] == ("reached" if high[0] < share < high[1] else "unreachable"), (share, least, got)
            assert got["steps"] < 120
            if got["status"] == "reached":
                sums = np.array(rated.agg(*[F.sum(F.col("posterior")[j] * F.col("n_tokens") * F.col("rate")) for j in range(2)]).first())
                assert np.abs(sums / sums.sum() / [share, 1 - share] - 1).max() < 1e-3, (share, least)
                assert least or abs(sums.sum() / got["start"].sum() - 1) < 1e-3
            assert rated.agg(F.min("rate")).first()[0] >= least


def test_three_domains_and_a_pull(spark):
    rows = spark.range(3000).selectExpr("id", "1 + pmod(hash(id), 50) as n_tokens", "array(pmod(hash(id, 1), 100) / 200.0, pmod(hash(id, 2), 100) / 200.0) as two").selectExpr("id", "cast(n_tokens as long) as n_tokens", "array(cast(two[0] as double), cast(two[1] as double), cast(1 - two[0] - two[1] as double)) as posterior").cache()
    for least in (0.0, 1.0):
        _, got = mixing.rates(rows, ["a", "b", "c"], {"a": 0.4, "b": 0.35, "c": 0.25}, least, pull=mixing.TIE)
        assert got["status"] == "reached" and np.abs(got["reached"] / got["aim"] - 1).max() < 1e-3
    _, got = mixing.rates(rows, ["a", "b", "c"], {"a": 0.9, "b": 0.1, "c": 0.0}, pull=mixing.TIE)
    assert got["status"] == "unreachable"
    _, got = mixing.rates(rows, ["a", "b", "c"], {"a": 0.4, "b": 0.35, "c": 0.25})
    assert got["status"] == "pulled"
