"""Near misses, scores, stored options, and lots that a list names more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wording import regions_conflict

#: Differences at most of a near miss.
MOST_DIFFERENCES = 2
# Fixed values of the score.
SUPPLIER, BORDER, SHORT, NEAR, UNPRICED, COVERAGE = 0.95, 0.9, 0.85, 0.5, 0.8, 0.9


def model_relation(a: Column, b: Column, a_tokens: Column, b_tokens: Column) -> Column:
    """same, close or null, from keys like brand:model and the models' words.

    close: one model's words are a proper part of the other's, have a digit somewhere, and all that
    is more are words of three letters or more.
    """
    brand, model = (lambda k: F.element_at(F.split(k, ":", 2), 1)), (lambda k: F.try_element_at(F.split(k, ":", 2), F.lit(2)))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    brands = blank(brand(a)) | blank(brand(b)) | (brand(a) == brand(b))
    small = F.when(F.size(a_tokens) <= F.size(b_tokens), a_tokens).otherwise(b_tokens)
    large = F.when(F.size(a_tokens) <= F.size(b_tokens), b_tokens).otherwise(a_tokens)
    extra = F.array_except(large, small)
    part = (F.size(F.array_except(small, large)) == 0) & (F.size(extra) > 0) & (F.size(small) > 0)
    worded = F.forall(extra, lambda w: w.rlike(r"^\p{L}{3,}$")) & F.exists(small, lambda w: w.rlike(r"\d"))
    return F.when(brands & ~blank(model(a)) & ~blank(model(b)), F.when(model(a) == model(b), "same").when(part & worded, "close"))


def differences(pairs: DataFrame) -> Column:
    """array<struct<name, offered, wanted>> of a pair with columns r_* (wanted) and s_* (offered).

    Capacity differs also where one side is null; colour, grade, ram, network and market only
    where both state them.
    """
    def differ(name: str, unless: Column) -> Column:
        return F.when(unless, F.struct(F.lit(name).alias("name"), F.col(f"s_{name}").cast("string").alias("offered"), F.col(f"r_{name}").cast("string").alias("wanted")))

    both = lambda c: F.coalesce(F.lower(F.col(f"r_{c}").cast("string")) != F.lower(F.col(f"s_{c}").cast("string")), F.lit(False))
    checks = [differ("capacity", ~F.col("r_capacity").eqNullSafe(F.col("s_capacity")))]
    checks += [differ(c, both(c)) for c in ("colour", "grade", "ram", "network") if f"r_{c}" in pairs.columns and f"s_{c}" in pairs.columns]
    if "r_region" in pairs.columns:
        checks.append(differ("region", regions_conflict(F.col("r_region"), F.col("s_region"))))
    return F.array_compact(F.array(*checks))


def near_misses(pairs: DataFrame) -> DataFrame:
    """Pairs with one or two differences; a close model counts as one of them."""
    out = pairs.withColumn("differences", differences(pairs))
    many = F.size("differences") + F.when(F.col("relation") == "close", 1).otherwise(0)
    return out.where(F.col("relation").isNotNull() & (many >= 1) & (many <= MOST_DIFFERENCES))


def score(margin: Column, filled: Column, wanted: Column, suppliers: Column, crosses: Column, near: Column, unpriced: Column) -> Column:
    """The rank of an option: its margin, less for each further supplier, a border, a shortfall, a near miss.

    Without a margin it is below zero, by what it covers.
    """
    covered = F.when(wanted > 0, F.least(F.lit(1.0), filled / wanted)).otherwise(F.lit(1.0))
    blind = F.lit(-1.0) + COVERAGE * covered * F.when(near, NEAR).otherwise(1.0) * F.when(unpriced, UNPRICED).otherwise(1.0)
    seen = margin * F.pow(F.lit(SUPPLIER), suppliers - 1) * F.when(crosses, BORDER).otherwise(1.0) * F.when(filled < wanted, SHORT).otherwise(1.0) * F.when(near, NEAR).otherwise(1.0)
    return F.when(margin.isNull(), blind).otherwise(seen)


def stored_options(options: Column, first: int = 5) -> Column:
    """The first options of a ranked array (with ``suppliers``), and any later one that brings a new supplier."""
    none = F.filter(options, lambda o: F.lit(False))
    start = F.struct(none.alias("kept"), F.array().cast("array<bigint>").alias("met"), F.lit(0).alias("n"))

    def step(s: Column, o: Column) -> Column:
        take = (s["n"] < first) | (F.size(F.array_except(o["suppliers"], s["met"])) > 0)
        return F.struct(
            F.when(take, F.concat(s["kept"], F.array(o))).otherwise(s["kept"]).alias("kept"),
            F.when(take, F.array_union(s["met"], o["suppliers"])).otherwise(s["met"]).alias("met"), (s["n"] + 1).alias("n"),
        )

    return F.aggregate(options, start, step, lambda s: s["kept"])


def once(lines: DataFrame, key: list[str]) -> DataFrame:
    """One row for each identity of a list, the first; a second batch of it adds its units.

    lines: key columns, position, batch (sheet and section), quantity, price_cents. A later line is a
    batch where the batch is the same and known, price is the same and known, and the quantity
    differs from what is gathered so far; else it is the same lot told twice.
    """
    line = F.struct("position", "batch", F.col("quantity").cast("bigint").alias("quantity"), "price_cents")
    each = lines.groupBy(*key).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    first = F.get("lines", F.lit(0))
    start = F.struct(first["quantity"].alias("quantity"), F.lit(0).alias("combined"), F.lit(0).alias("duplicates"))

    def step(s: Column, x: Column) -> Column:
        more = F.coalesce((x["batch"] != "") & (x["batch"] == first["batch"]) & (x["quantity"] != s["quantity"]) & (x["price_cents"] == first["price_cents"]), F.lit(False))
        return F.struct(F.when(more, s["quantity"] + x["quantity"]).otherwise(s["quantity"]).alias("quantity"), (s["combined"] + more.cast("int")).alias("combined"), (s["duplicates"] + (~more).cast("int")).alias("duplicates"))

    done = each.withColumn("s", F.aggregate(F.slice("lines", F.lit(2), F.size("lines")), start, step))
    return done.select(*key, F.col("s.quantity").alias("quantity"), first["price_cents"].alias("price_cents"), F.col("s.combined").alias("combined"), F.col("s.duplicates").alias("duplicates"))
