"""Tables whose columns somebody else has to name: what is asked, once for each header, and which answers are believed.

A question is the signature of a header: its cells and the table's width, so a list that comes every morning
is asked about once. Answers are a table; each is held against sampled cells of the very grid it is used for, and what was
found is kept by signature, a refusal as well.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as n
from .extract import GRID

# Fields an answer may name, most columns of a question, rows of a sample and how far down they are looked for, the share of cells that bears a claim out.
FIELDS = ["description", "ean", "price", "quantity", "currency", "colour", "capacity", "grade", "brand", "region"]
MOST_COLUMNS, SAMPLE_ROWS, SAMPLE_DEPTH, AGREE = 20, 5, 40, 0.6


def unread(grid: DataFrame, heads: DataFrame) -> DataFrame:
    """(GRID, head, signature, header, width, sample) of grids (GRID, row_idx, cells) without a row in ``heads``.

    The first row is the header unless it holds a price; the sample is the first rows below with anything in them.
    """
    rows = grid.join(heads.select(*GRID).distinct(), GRID, "left_anti").where(F.col("row_idx") <= SAMPLE_DEPTH)
    labels = ~F.exists("cells", lambda c: n.parse_price(c).isNotNull())
    first = rows.where("row_idx = 0").select(*GRID, F.when(labels, F.col("cells")).otherwise(F.array().cast("array<string>")).alias("header"))
    below = rows.join(first, GRID).where(F.exists("cells", lambda c: F.trim(c) != "") & ((F.col("row_idx") > 0) | (F.size("header") == 0)))
    turn = F.row_number().over(Window.partitionBy(*GRID).orderBy("row_idx"))
    below = below.withColumn("turn", turn).where(F.col("turn") <= SAMPLE_ROWS)
    each = below.groupBy(*GRID, "header").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda x: x["cells"]).alias("sample"))
    width = F.least(F.lit(MOST_COLUMNS), F.greatest(F.size("header"), F.array_max(F.transform("sample", F.size))))
    signature = F.concat(F.col("width").cast("string"), F.lit(":"), F.array_join(F.transform(F.slice("header", 1, MOST_COLUMNS), lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))), "|"))
    each = each.withColumn("width", width).where("width >= 2").withColumn("signature", signature)
    return each.select(*GRID, F.when(F.size("header") > 0, 0).otherwise(-1).alias("head"), "signature", "header", "width", "sample")


def to_ask(tables: DataFrame, known: DataFrame) -> DataFrame:
    """(signature, header, width, sample) once for each signature of ``unread`` that ``known`` (signature, fields) does not have."""
    first = F.row_number().over(Window.partitionBy("signature").orderBy(*GRID))
    return tables.join(known.select("signature").distinct(), "signature", "left_anti").withColumn("turn", first).where("turn = 1").select("signature", "header", "width", "sample")


def _claimed(answer: Column, width: Column) -> Column:
    """The claims (field, at) of an answer that name a field and a column there is; of one column or field the first."""
    sound = F.filter(answer, lambda x: x["field"].isin(FIELDS) & (x["at"] >= 0) & (x["at"] < width))

    def first_of(part: str, all_: Column) -> Column:
        values = F.transform(all_, lambda x: x[part])
        return F.filter(all_, lambda x, i: F.array_position(values, x[part]) == i + 1)

    return F.transform(F.array(first_of("at", sound)), lambda x: first_of("field", x))[0]


def _many(cells: Column, test: Callable[[Column], Column]) -> Column:
    """How many cells pass a test."""
    return F.size(F.filter(cells, lambda c: F.coalesce(test(c), F.lit(False))))


def judged(tables: DataFrame, answers: DataFrame) -> DataFrame:
    """``unread`` tables with an answer (signature, answer: array of struct(field, at)): verdict and the fields believed.

    A description and a price have to hold up in the sampled cells or the answer is refused; a quantity or a barcode that does not
    is dropped. verdict: accepted, half (claims were dropped) or refused; fields is a map, null where refused.
    """
    rows = tables.join(answers, "signature").withColumn("claims", _claimed(F.col("answer"), F.col("width")))
    checks = {"description": n.is_wordy, "price": lambda v: n.parse_price(v).isNotNull(), "quantity": lambda v: n.quantity(v).isNotNull(), "ean": lambda v: v.rlike(r"^(?:\d{8}|\d{12,14})$")}

    def holds(claim: Column) -> Column:
        cells = F.filter(F.transform("sample", lambda r: F.trim(F.get(r, claim["at"]))), lambda c: F.coalesce(c != "", F.lit(False)))
        agree = [(claim["field"] == field) & (_many(cells, test) >= AGREE * F.size(cells)) for field, test in checks.items()]
        return ~claim["field"].isin(list(checks)) | ((F.size(cells) >= 2) & reduce(lambda a, b: a | b, agree))

    rows = rows.withColumn("kept", F.filter("claims", holds))
    named = lambda c, *fields: F.exists(c, lambda x: x["field"].isin(list(fields)))
    usable = lambda c: named(c, "description") & named(c, "price", "quantity")
    refused = ~usable("claims") | ~usable("kept") | (named("claims", "price") & ~named("kept", "price"))
    verdict = F.when(refused, "refused").when(F.size("kept") < F.size("claims"), "half").otherwise("accepted")
    fields = F.when(verdict != "refused", F.map_from_entries(F.transform("kept", lambda x: F.struct(x["field"], x["at"]))))
    return rows.select(*GRID, "head", "signature", verdict.alias("verdict"), fields.alias("fields"))


def remembered(known: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``known`` (signature, fields) with what the first grid of each new signature came to; a refusal is kept as a null."""
    first = F.row_number().over(Window.partitionBy("signature").orderBy(*GRID))
    new = verdicts.join(known.select("signature"), "signature", "left_anti").withColumn("turn", first).where("turn = 1").select("signature", "fields")
    return known.select("signature", "fields").unionByName(new)
