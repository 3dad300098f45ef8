"""Deals and what they commit: margins that are known or null, and whether a lot can be promised again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def margins(legs: DataFrame, deal: str) -> DataFrame:
    """(deal, margin): sold less bought in cents; null where a side is missing or a leg has no price. legs: side, quantity, price_cents."""
    value = F.col("quantity") * F.col("price_cents")
    by = legs.groupBy(deal).agg(F.sum(F.when(F.col("side") == "buy", value)).alias("bought"), F.sum(F.when(F.col("side") == "sell", value)).alias("sold"), F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"), F.count_if(F.col("price_cents").isNull()).alias("unpriced"))
    known = (F.col("buys") > 0) & (F.col("sells") > 0) & (F.col("unpriced") == 0)
    return by.select(deal, F.when(known, F.col("sold") - F.col("bought")).alias("margin"))


def committed_elsewhere(rows: DataFrame, lot: list[str]) -> DataFrame:
    """``rows`` with elsewhere: units of the lot in open deals other than the row's own. rows: lot, deal, committed (the units
    that the row itself binds in an open deal, or 0). One sort of each lot's rows, which lie in one task."""
    total = lambda *by: F.sum(F.coalesce("committed", F.lit(0))).over(Window.partitionBy(*by))
    return rows.withColumn("__all", total(*lot)).withColumn("elsewhere", F.col("__all") - total(*lot, "deal")).drop("__all")


def allocation(wanted: Column, lot_quantity: Column, elsewhere: Column) -> Column:
    """struct(allowed, remaining, warning): whether so many units of a lot may be promised.

    A lot of unknown size is allowed with a warning; one that is promised elsewhere too, as long as
    enough is left.
    """
    left = lot_quantity - elsewhere
    said = lambda ok, remaining, warning: F.struct(F.lit(ok).alias("allowed"), remaining.cast("bigint").alias("remaining"), warning.cast("string").alias("warning"))
    none = F.lit(None)
    return (
        F.when(wanted <= 0, said(False, none, none)).when(lot_quantity.isNull(), said(True, none, F.when(elsewhere > 0, "committed elsewhere").otherwise("no stated quantity")))
        .when(wanted > left, said(False, F.greatest(left, F.lit(0)), none)).otherwise(said(True, left - wanted, F.when(elsewhere > 0, "committed elsewhere")))
    )


def freshness(at: Column, now: Column) -> Column:
    """today, recent or stale: up to 24 and 72 hours old."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp(at)) / 3600
    return F.when(hours <= 24, "today").when(hours <= 72, "recent").otherwise("stale")
