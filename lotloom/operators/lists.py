"""What an arriving list may do: its wording, how late it is, replace or add, and the note of the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: wording of a whole list, of an addition, and the prefixes that either may have.
WHOLE = (
    r"(?i)\b(?:price\s*list|pricelist|preisliste|prijslijst|listino|lista\s*de\s*precios|lista\s*preturi|liste\s*de\s*prix|stock\s*list|stocklist|stock\s*sheet|"
    r"lagerliste|lagerbestand|full\s*stock|current\s*stock|available\s*stock|wts|want\s*to\s*sell|wtb|want\s*to\s*buy|daily\s*(?:list|offer|stock))\b"
)
PREFIX = r"(?i)^(?:wts|want\s*to\s*sell|wtb|want\s*to\s*buy)$"
EXTRA = (
    r"(?i)\b(?:just\s*(?:got|arrived|in)|new\s*arrivals?|newly\s*arrived|additional|extra\s*stock|also\s*(?:have|available)|on\s*top\s*of|in\s*addition|"
    r"(?:some|few|a\s*few)\s*more|more\s*stock|forgot|missed\s*(?:these|this|out)|special\s*offer|one\s*off|last\s*(?:few|units)|"
    r"clearance|quick\s*deal|urgent\s*sale|nachschub|neu\s*eingetroffen)\b"
)
# A closing of so many lines and such a share of the live ones is heavy; separators of a note.
HEAVY, SHARE = 10, 0.4
SEPARATOR, END = " · ", " ||"


def wording(subject: Column, body: Column) -> Column:
    """struct(whole, trade_prefix, extra): the first words of each kind, null without."""
    text = F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    found = F.regexp_extract_all(text, F.lit(WHOLE), F.lit(0))
    first = lambda keep: F.get(F.filter(found, keep), F.lit(0))
    return F.struct(first(lambda w: ~w.rlike(PREFIX)).alias("whole"), first(lambda w: w.rlike(PREFIX)).alias("trade_prefix"), F.nullif(F.regexp_extract(text, EXTRA, 0), F.lit("")).alias("extra"))


def lateness(arriving: DataFrame, applied: DataFrame, zone: str = "UTC") -> DataFrame:
    """``arriving`` with superseded (array of categories), behind and late.

    arriving: id, sender, side, at, habits (array; '' stands for uncategorised); applied: sender, side,
    at, whole (three-valued), categories (array, null for all). Of a sender's newer lists on the same
    categories a whole one of another local day supersedes them; any other leaves the arriving list
    behind. A list meets three instants of each of its categories, not the sender's lists: the last day of a whole
    one, the last of the others, and the last whole one of its own day.
    """
    day, who = lambda c: F.to_date(F.from_utc_timestamp(c, zone)), ["sender", "side", "category"]
    each = applied.select("sender", "side", "at", F.coalesce("whole", F.lit(False)).alias("whole"), F.explode(F.coalesce("categories", F.array(F.lit("*")))).alias("category"))
    last = each.groupBy(*who).agg(F.max(F.when(F.col("whole"), day(F.col("at")))).alias("whole_day"), F.max(F.when(~F.col("whole"), F.col("at"))).alias("other_at"))
    same_day = each.where("whole").groupBy(*who, day(F.col("at")).alias("day")).agg(F.max("at").alias("whole_at"))
    asks = arriving.select("id", "sender", "side", "at", day(F.col("at")).alias("day"), F.explode("habits").alias("habit")).withColumn("category", F.explode(F.array_distinct(F.array("habit", F.lit("*")))))
    met = asks.join(last, who, "left").join(same_day, [*who, "day"], "left")
    over, behind = F.coalesce(F.col("whole_day") > F.col("day"), F.lit(False)), F.coalesce(F.col("other_at") > F.col("at"), F.lit(False)) | F.coalesce(F.col("whole_at") > F.col("at"), F.lit(False))
    by = met.groupBy("id").agg(F.array_sort(F.collect_set(F.when(over, F.col("habit")))).alias("over_habits"), F.max(behind.cast("int")).alias("is_behind"))
    rows = arriving.join(by, "id", "left").withColumns({"superseded": F.coalesce("over_habits", F.array().cast("array<string>")), "behind": F.coalesce(F.col("is_behind") == 1, F.lit(False))}).drop("over_habits", "is_behind")
    return rows.withColumn("late", F.col("behind") | (F.size("superseded") > 0))


def confirmed_before(arriving: DataFrame, applied: DataFrame, zone: str = "UTC") -> DataFrame:
    """``arriving`` (id, sender, side, at) with ``confirmed``: categories that whole lists of its sender have confirmed that local day before it,
    and ``confirmed_all`` where one of them covered everything. A list in a category not yet confirmed that day may replace; others only add."""
    day = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    first = applied.where("whole").select("sender", "side", "at", day(F.col("at")).alias("day"), F.explode(F.coalesce("categories", F.array(F.lit("*")))).alias("category")).groupBy("sender", "side", "day", "category").agg(F.min("at").alias("since"))
    met = arriving.select("id", "sender", "side", "at", day(F.col("at")).alias("day")).join(first, ["sender", "side", "day"]).where("since < at")
    by = met.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("category") != "*", F.col("category")))).alias("some"), F.max((F.col("category") == "*").cast("int")).alias("all"))
    return arriving.join(by, "id", "left").withColumns({"confirmed": F.coalesce("some", F.array().cast("array<string>")), "confirmed_all": F.coalesce(F.col("all") == 1, F.lit(False))}).drop("some", "all")


def keeps_row(category: Column, habits: Column, superseded: Column) -> Column:
    """A row of a late list stays unless its category, or for a stray one every habit, is superseded. '' stands for uncategorised."""
    c = F.coalesce(category, F.lit(""))
    return F.when(F.array_contains(habits, c), ~F.array_contains(superseded, c)).otherwise(F.size(F.array_except(habits, superseded)) > 0)


def confirmed_categories(applied: DataFrame, zone: str = "UTC") -> DataFrame:
    """(sender, side, day, categories): what whole lists of a day have confirmed; null where one of them covered everything."""
    whole = applied.where("whole").withColumn("day", F.to_date(F.from_utc_timestamp("at", zone)))
    by = whole.groupBy("sender", "side", "day").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"), F.max(F.col("categories").isNull().cast("int")).alias("__all"))
    return by.withColumn("categories", F.when(F.col("__all") == 0, F.col("categories"))).drop("__all")


def settled(complete: Column, why: Column, words: Column, would_close: Column, live: Column, checker: Column, asked: Column) -> Column:
    """struct(action, is_complete, decided_by, reasons): replace or add.

    words: of ``wording``; checker: complete, addition or null; asked: whether there is a checker. It
    counts only where the wording points both ways, says nothing, or much would be closed.
    """
    said = F.coalesce(words["whole"], words["trade_prefix"])
    conflict, silent = said.isNotNull() & words["extra"].isNotNull(), said.isNull() & words["extra"].isNull()
    heavy = (would_close >= HEAVY) & (live > 0) & (would_close >= live * SHARE)
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    doubt = (
        F.when(conflict, F.concat(F.lit("the wording points both ways ("), quoted(said), F.lit(" and "), quoted(words["extra"]), F.lit(")"))).when(silent, "no wording says whether it is the whole list")
        .when(heavy, F.concat(F.lit("it would close "), would_close.cast("string"), F.lit(" of "), live.cast("string"), F.lit(" live lines")))
    )
    closes = F.concat(F.lit("closes "), would_close.cast("string"), F.lit(" missing lines as sold"))
    unanswered = F.when(F.coalesce(asked, F.lit(False)), "checker could not tell").otherwise("checker unavailable")

    def made(action: str, whole: Column, by: Column, *reasons: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), whole.alias("is_complete"), by.alias("decided_by"), F.array(*reasons).alias("reasons"))

    yes, no, open_ = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    rules = F.lit("rules")
    return (
        F.when(~complete.eqNullSafe(F.lit(True)), made("add", complete, rules, why)).when(would_close == 0, made("replace", yes, rules, why, F.lit("closes nothing")))
        .when(doubt.isNull(), made("replace", yes, rules, why, closes)).when(checker == "complete", made("replace", yes, F.lit("rules, confirmed by the checker"), why, doubt, closes))
        .when(checker == "addition", made("add", no, F.lit("rules, overruled by the checker"), why, doubt, F.lit("the checker read the email as extra stock; closed nothing")))
        .when(conflict | heavy, made("add", open_, F.concat(F.lit("rules; "), unanswered), why, doubt, F.concat(unanswered, F.lit("; closed nothing until a list says so clearly"))))
        .otherwise(made("replace", yes, F.concat(F.lit("rules; "), unanswered), why, doubt, F.concat(unanswered, F.lit("; read as the whole list, as this sender's lists are")), closes))
    )


def note(action: Column, decided_by: Column, reasons: Column) -> Column:
    """A decision as text that ``parsed_note`` reads back; other notes may follow it."""
    return F.concat(F.lit("decision: "), action, F.lit(" ("), decided_by, F.lit(") -- "), F.array_join(reasons, SEPARATOR), F.lit(END))


def parsed_note(text: Column) -> Column:
    """struct(action, decided_by, reasons, rest) of a note, null for text that is none."""
    parts = F.split(text, r" \|\|", 2)
    head = F.substring(F.get(parts, F.lit(0)), 11, 1_000_000)
    label, reasons = F.substring_index(head, " -- ", 1), F.get(F.split(head, " -- ", 2), F.lit(1))
    by = F.trim(F.regexp_replace(F.get(F.split(label, r" \(", 2), F.lit(1)), r"\)+$", ""))
    each = F.filter(F.split(F.coalesce(reasons, F.lit("")), SEPARATOR), lambda r: r != "")
    rest = F.trim(F.regexp_replace(F.get(parts, F.lit(1)), r"^[; ]+", ""))
    read = F.struct(F.trim(F.substring_index(label, " (", 1)).alias("action"), F.coalesce(F.nullif(by, F.lit("")), F.lit("rules")).alias("decided_by"), each.alias("reasons"), rest.alias("rest"))
    return F.when(text.startswith("decision: ") & F.contains(text, F.lit(END)), read)


def held_preview(held: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Each row of a held list beside the live lot of its key: insert, update or refresh, with the values now."""
    now = live.select(*key, F.col("quantity").alias("old_quantity"), F.col("price_cents").alias("old_price"), F.lit(True).alias("__was"))
    same = F.col("quantity").eqNullSafe(F.col("old_quantity")) & F.col("price_cents").eqNullSafe(F.col("old_price"))
    return held.join(now, key, "left").withColumn("kind", F.when(F.col("__was").isNull(), "insert").when(same, "refresh").otherwise("update")).drop("__was")


def held_settled(held: DataFrame, live: DataFrame, key: list[str], resolution: str, chosen: DataFrame | None = None, of: list[str] | None = None) -> DataFrame:
    """(key, kind) that an answer to held lists asks for.

    ``of``: the columns of ``key`` that tell lists apart, such as the sender; without them all rows are one list.
    same: rows that the board has are refreshed. new: a list replaces its sender's live rows, what it leaves
    out is closed, unless it is shorter than half of them. partial: chosen rows are inserted or
    updated, nothing is closed.
    """
    preview = held_preview(held, live, key)
    if resolution == "same":
        return preview.where("kind <> 'insert'").select(*key, F.lit("refresh").alias("kind"))
    if resolution == "partial":
        return preview.join(chosen.select(*key).distinct(), key, "left_semi").select(*key, F.when(F.col("kind") == "insert", "insert").otherwise("update").alias("kind"))
    if resolution != "new":
        raise ValueError(f"unknown resolution {resolution!r}")
    one = of or ["one"]
    sized = lambda rows, name: (rows if of else rows.withColumn("one", F.lit(1))).groupBy(*one).agg(F.count("*").alias(name))
    closing = sized(held, "n").join(sized(live, "live"), one).where("n >= 0.5 * live").select(*one)
    gone = (live if of else live.withColumn("one", F.lit(1))).join(held.select(*key), key, "left_anti").join(closing, one, "left_semi").select(*key, F.lit("close").alias("kind"))
    return preview.select(*key, "kind").unionByName(gone)
