"""Sheets read beside each other, and price columns beside each other: summaries that are no more stock, and the currency of a bare price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as n

# The share of covered rows and the rows at least that make a sheet a summary.
SUMMARY_SHARE, LEAST_COVERED = 0.6, 3
# How far conversions of one price may scatter, how near to 1 a column is the same price, and the rows looked at.
SCATTER, EQUAL, LOOKED_AT = 1.03, 0.01, 80
# From and to currency, and the least and most that one unit of the first is in the second.
RATE_BANDS = {
    ("GBP", "EUR"): (1.10, 1.30), ("GBP", "USD"): (1.18, 1.45), ("EUR", "USD"): (1.00, 1.25), ("EUR", "GBP"): (0.77, 0.91), ("USD", "EUR"): (0.80, 1.00), ("USD", "GBP"): (0.69, 0.85),
}
CANDIDATES = ["GBP", "EUR", "USD"]


def summary_coverage(rows: DataFrame, message: str, grid: str) -> DataFrame:
    """``rows`` with ``covered`` and ``summary``: whether other sheets of the message carry a row by colour, and whether its sheet only totals them.

    rows: description_key, capacity_gb, price_cents, currency, availability, grade, colour and quantity beside the ids. A row is covered where
    sheets with colours have the same product at the same price, and their quantities add up to its own, if it has one. A sheet
    without colours is a summary if most of its rows are covered. Sums by product meet rows in one equi-join.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = [message, "what", "capacity", "cents"]
    keyed = rows.withColumns({
        "what": F.concat_ws("\u0001", blank("description_key"), F.upper(blank("currency")), blank("availability"), F.upper(blank("grade"))), "capacity": F.coalesce("capacity_gb", F.lit(-1)), "cents": F.coalesce("price_cents", F.lit(-1)),
    })
    keyed = keyed.withColumn("coloured", F.max(F.coalesce(F.col("colour") != "", F.lit(False))).over(Window.partitionBy(message, grid)))
    detail = keyed.where("coloured").groupBy(*key).agg(F.sum("quantity").alias("total"))
    met = keyed.join(detail.withColumn("there", F.lit(True)), key, "left")
    covered = ~F.col("coloured") & F.coalesce(F.col("there"), F.lit(False)) & F.coalesce(F.col("quantity").isNull() | (F.col("quantity") == F.col("total")), F.lit(False))
    met = met.withColumn("covered", covered)
    sheet = Window.partitionBy(message, grid)
    many = F.count_if("covered").over(sheet)
    met = met.withColumn("summary", (many >= LEAST_COVERED) & (many >= SUMMARY_SHARE * F.count("*").over(sheet)))
    return met.select(*rows.columns, "covered", "summary")


def without_summaries(rows: DataFrame, message: str, grid: str) -> DataFrame:
    """``rows`` without those that only total others of their message; rows of a summary that no other sheet has stay."""
    return summary_coverage(rows, message, grid).where("not (covered and summary)").select(*rows.columns)


def bare_currency(cells: DataFrame, grid: str, hint: str | None = None) -> DataFrame:
    """(grid, how, currency, column) for each grid that has a price column without a currency beside labelled ones.

    cells: grid, n (row of the body, from 0), price (text of the bare column), others (array of struct(code, price), in order of the columns).
    how: equal to a labelled column; band: the only currency of which all conversions are plausible rates; switched: the first
    labelled column takes its place (``column``, else null). Ratios come from the first rows; those of one column count if there are two and they scatter little.
    """
    base = n.parse_price(F.col("price"), hint)
    near = cells.where(F.col("n") < LOOKED_AT).withColumn("base", base)
    each = near.select(grid, "base", F.posexplode("others").alias("at", "other")).select(grid, "base", "at", "other.code", n.parse_price(F.col("other.price"), hint).alias("amount"))
    ratios = each.where("base > 0 and amount > 0").groupBy(grid, "at", "code").agg(F.array_sort(F.collect_list(F.col("amount") / F.col("base"))).alias("r"))  # LOOKED_AT at most
    count, first, last = F.size("r"), F.element_at("r", 1), F.element_at("r", -1)
    ratios = ratios.where((count >= 2) & (last / first <= SCATTER)).select(grid, "at", "code", F.element_at("r", F.floor(count / 2).cast("int") + 1).alias("median"))
    medians = ratios.groupBy(grid).agg(F.array_sort(F.collect_list(F.struct("at", "code", "median"))).alias("medians"))
    columns = cells.groupBy(grid).agg(F.max(F.transform("others", lambda x: x["code"])).alias("codes")).join(medians, grid, "left")

    def fits(candidate: str) -> Column:
        def plausible(x: Column) -> Column:
            checks = [(x["code"] == to) & x["median"].between(*band) for (of, to), band in RATE_BANDS.items() if of == candidate]
            out = checks[0]
            for c in checks[1:]:
                out = out | c
            return out

        return F.when(~F.array_contains("codes", candidate) & F.forall("medians", plausible), F.lit(candidate))

    equal = F.get(F.filter("medians", lambda x: F.abs(x["median"] - 1) <= EQUAL), F.lit(0))["code"]
    some = F.array_compact(F.array(*map(fits, CANDIDATES)))
    only = F.when(F.col("medians").isNotNull() & (F.size(some) == 1), F.get(some, F.lit(0)))
    how = F.when(equal.isNotNull(), "equal").when(only.isNotNull(), "band").otherwise("switched")
    return columns.select(grid, how.alias("how"), F.coalesce(equal, only, F.get("codes", F.lit(0))).alias("currency"), F.when(how == "switched", 0).alias("column"))


def priced(cells: DataFrame, grid: str, hint: str | None = None) -> DataFrame:
    """``cells`` with ``amount`` and ``currency`` as ``bare_currency`` decides for their grid, and how it was decided."""
    rows = cells.join(bare_currency(cells, grid, hint), grid)
    text = F.when(F.col("column").isNull(), F.col("price")).otherwise(F.get("others", F.col("column"))["price"])
    return rows.withColumn("amount", n.parse_price(text, hint)).drop("column")
