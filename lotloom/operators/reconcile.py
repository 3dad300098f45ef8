"""A new list against the current state: actions, guards, differences, fingerprints, day rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A list of fewer rows than this share of the last one may not close lots; a price that
# moves by this factor is looked at.
LEAST_SHARE, JUMP = 0.5, 5

KEY = ["supplier", "part"]


def joined(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both snapshots side by side, full outer on the identity."""
    old = existing.select(*KEY, F.col("quantity").alias("old_quantity"), F.col("price_cents").alias("old_price"), F.lit(True).alias("was"))
    new = incoming.select(*KEY, F.col("quantity").alias("new_quantity"), F.col("price_cents").alias("new_price"), F.lit(True).alias("is"))
    return old.join(new, KEY, "full_outer").withColumns({"was": F.coalesce("was", F.lit(False)), "is": F.coalesce("is", F.lit(False))})


def moved(a: str, b: str) -> Column:
    """True where two values differ, null against a value too."""
    return ~F.col(a).eqNullSafe(F.col(b))


def may_close(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """supplier, closes: whether the list is long enough beside the last one to close what it leaves out."""
    before = existing.groupBy("supplier").agg(F.count("*").alias("before"))
    now = incoming.groupBy("supplier").agg(F.count("*").alias("now"))
    return now.join(before, "supplier", "left").select("supplier", (F.col("before").isNull() | (F.col("now") >= F.col("before") * LEAST_SHARE)).alias("closes"))


def actions(existing: DataFrame, incoming: DataFrame, complete: bool | None = True) -> DataFrame:
    """kind for each lot: insert, update, refresh, close, or keep where closing isn't permitted.

    ``complete`` is three-valued: None is undecided and closes nothing, as False does.
    """
    rows = joined(existing, incoming).join(may_close(existing, incoming), "supplier", "left")
    permitted = F.coalesce("closes", F.lit(False)) & F.lit(complete is True)
    changed = moved("old_quantity", "new_quantity") | moved("old_price", "new_price")
    kind = F.when(~F.col("was"), "insert").when(~F.col("is"), F.when(permitted, "close").otherwise("keep")).when(changed, "update").otherwise("refresh")
    jump = (F.col("old_price") > 0) & (F.col("new_price") > 0) & ((F.col("new_price") >= F.col("old_price") * JUMP) | (F.col("old_price") >= F.col("new_price") * JUMP))
    return rows.select(*KEY, kind.alias("kind"), "old_quantity", "new_quantity", "old_price", "new_price", F.coalesce(jump, F.lit(False)).alias("needs_review"))


def applied(existing: DataFrame, acts: DataFrame) -> DataFrame:
    """The new snapshot after the actions: closed lots gone, others at their new values."""
    live = acts.where("kind <> 'close'")
    return live.select(*KEY, F.coalesce("new_quantity", "old_quantity").alias("quantity"), F.when(F.col("kind") == "keep", F.col("old_price")).otherwise(F.col("new_price")).alias("price_cents"))


def field_changes(acts: DataFrame) -> DataFrame:
    """One row for each changed field of an update or close: field, old, new as text."""
    text = lambda c: F.col(c).cast("string")
    changes = F.array_compact(F.array(
        F.when((F.col("kind") == "update") & moved("old_price", "new_price"), F.struct(F.lit("price").alias("field"), text("old_price").alias("old"), text("new_price").alias("new"))),
        F.when((F.col("kind") == "update") & moved("old_quantity", "new_quantity"), F.struct(F.lit("quantity").alias("field"), text("old_quantity").alias("old"), text("new_quantity").alias("new"))),
        F.when(F.col("kind") == "close", F.struct(F.lit("status").alias("field"), F.lit("live").alias("old"), F.lit("sold").alias("new"))),
    ))
    return acts.select(*KEY, F.explode(changes).alias("c")).select(*KEY, "c.field", "c.old", "c.new")


def undone(acts: DataFrame) -> DataFrame:
    """What taking a list back does: lots it brought are withdrawn, lots it closed are live again."""
    kind = F.when(F.col("kind") == "insert", "withdrawn").when(F.col("kind") == "close", "reopened")
    return acts.select(*KEY, kind.alias("undo")).where("undo is not null")


def difference(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """appeared, vanished, price (also where both moved), quantity or unchanged."""
    kind = F.when(~F.col("was"), "appeared").when(~F.col("is"), "vanished").when(moved("old_price", "new_price"), "price").when(moved("old_quantity", "new_quantity"), "quantity").otherwise("unchanged")
    return joined(existing, incoming).select(*KEY, kind.alias("kind"))


def difference_summary(diff: DataFrame) -> DataFrame:
    """"3 new, 1 gone, 2 changed" for each supplier, or identical."""
    n = diff.groupBy("supplier").agg(F.count_if(F.col("kind") == "appeared").alias("a"), F.count_if(F.col("kind") == "vanished").alias("g"), F.count_if(F.col("kind").isin("price", "quantity")).alias("c"))
    part = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" " + word)))
    text = F.concat_ws(", ", part("a", "new"), part("g", "gone"), part("c", "changed"))
    return n.select("supplier", F.when(text == "", "identical").otherwise(text).alias("summary"))


def fingerprint(rows: DataFrame, currency: str = "EUR") -> DataFrame:
    """SHA-256 of a supplier's list: the count, then each row's fingerprint in order, one a line."""
    price = F.concat(F.expr("price_cents div 100").cast("string"), F.lit("."), F.lpad((F.col("price_cents") % 100).cast("string"), 2, "0"))
    one = F.concat_ws("|", F.col("part").cast("string"), F.coalesce(F.col("quantity").cast("string"), F.lit("")), F.coalesce(price, F.lit("")), F.lit(currency))
    got = rows.select("supplier", one.alias("row")).groupBy("supplier").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return got.select("supplier", F.size("rows").cast("bigint").alias("n_rows"), F.sha2(F.concat_ws("\n", F.size("rows").cast("string"), F.array_join("rows", "\n")), 256).alias("fingerprint"))


def habitual(rows: DataFrame, key: str, category: str) -> DataFrame:
    """Categories a sender's list habitually has: two rows or more, or a tenth of all its rows."""
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    each = rows.where(F.col(category).isNotNull()).groupBy(key, category).agg(F.count("*").alias("n"))
    return each.join(total, key).where((F.col("n") >= 2) | (F.col("n") * 10 >= F.col("total"))).select(key, category, "n")


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, unknown times last."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.desc(tie))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def same_day(rows: DataFrame, key: str, at: str, content: str, tie: str, zone: str = "UTC") -> DataFrame:
    """apply, same or hold for each list, from the one before it of that sender.

    apply: there is none, or it came on another local day; same: equal content; hold otherwise.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    day = F.to_date(F.from_utc_timestamp(F.col(at), zone))
    rows = rows.withColumn("__day", day).withColumn("__prior_day", F.lag("__day").over(w)).withColumn("__prior", F.lag(content).over(w))
    what = F.when(F.col("__prior_day").isNull() | (F.col("__prior_day") != F.col("__day")), "apply").when(F.col("__prior").eqNullSafe(F.col(content)), "same").otherwise("hold")
    return rows.withColumn("decision", what).drop("__day", "__prior_day", "__prior")


def list_scope(live: DataFrame, covered: list[str | None], confirmed: list[str | None] = ()) -> DataFrame:
    """The live rows (id, category, email) that a list of these categories speaks for.

    Categories: those covered, and all that share an email with one of them by habit, less those a
    whole list confirmed today. A row of its email's habits is spoken for by its category; a stray
    or uncategorised one by its email, if that has any such habit. A list without any category
    speaks for uncategorised rows, unless uncategorised ones are confirmed.
    """
    real = sorted({c for c in covered if c is not None})
    if not real:
        return live.where("category is null").select("id") if None not in confirmed else live.limit(0).select("id")
    rows = live.withColumn("email", F.coalesce("email", F.concat(F.lit("row:"), F.col("id").cast("string"))))
    habits = habitual(rows, "email", "category").groupBy("email").agg(F.collect_set("category").alias("habits"))
    rows = rows.join(habits, "email", "left").withColumn("habits", F.coalesce("habits", F.array().cast("array<string>")))
    also = habits.where(F.arrays_overlap("habits", F.array(*map(F.lit, real)))).select(F.explode("habits").alias("c"))
    spoken = also.unionByName(live.sparkSession.createDataFrame([(c,) for c in real], "c string")).distinct().where(~F.col("c").isin([c for c in confirmed if c is not None]))
    any_habit = habits.select("email", F.explode("habits").alias("c")).join(spoken, "c", "left_semi").select("email").distinct().withColumn("speaks", F.lit(True))
    rows = rows.join(any_habit, "email", "left").join(spoken.withColumn("named", F.lit(True)), F.col("category") == F.col("c"), "left")
    by_habit = F.coalesce(F.array_contains("habits", F.col("category")), F.lit(False))
    return rows.where(F.when(by_habit, F.col("named")).otherwise(F.col("speaks"))).select("id")
