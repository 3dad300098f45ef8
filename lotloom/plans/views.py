"""What users look at: filters, sorts, reports and counts over the tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants
from ..operators import deals
from ..sources.tables import cents, lots, table

#: Instant that ages are counted from.
NOW = "2024-02-01 00:00:00"


def lists_since(spark, sf_dir) -> DataFrame:
    """Applied lists of each sender since an instant, the newest 40 of each."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("turn", turn).where("turn <= 40").select("event_id", "user_id", "ts")


def stored_board_filter(spark, sf_dir) -> DataFrame:
    """Lots by brand without regard to case, a supplier out of several, and words that all stand in the description; % and _ are letters."""
    words = ["an", "e"]
    escaped = [w.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for w in words]
    rows = lots(spark, sf_dir).where(F.col("brand").ilike("brand#1%")).where(F.array_contains(F.array(*[F.lit(k).cast("bigint") for k in (3, 7, 11)]), F.col("supplier").cast("bigint")))
    for w in escaped:
        rows = rows.where(F.col("description").ilike(f"%{w}%"))
    return rows.select("supplier", "part", "brand", "description")


def offer_search(spark, sf_dir) -> DataFrame:
    """Lots whose description, brand or category holds a text, without regard to case, and how many there are in all."""
    hit = F.col("description").ilike("%green%") | F.col("brand").ilike("%#22%") | F.col("category").ilike("%plated nickel%")
    rows = lots(spark, sf_dir).where(hit)
    first = rows.orderBy(F.desc("seen_at"), "supplier", "part").limit(500).select("supplier", "part")
    total = rows.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return first.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")  # a single row is broadcast


def review_queue(spark, sf_dir) -> DataFrame:
    """Documents that need a person: no language or low quality, newest first, with the reason and the first 400 characters."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sender, kind = F.col("doc_id") % 7 == 0, F.coalesce(F.col("quality") == 0, F.lit(False))
    why = F.when(sender & kind, "both").when(sender, "sender").when(kind, "classification")
    return d.where(sender | kind).orderBy(F.desc("doc_id")).limit(300).select("doc_id", why.alias("reason"), F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("preview"))


def pending_imports(spark, sf_dir) -> DataFrame:
    """Imports that wait for a person: neither approved nor rejected, in a state that needs one."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 5 == 0, "failed").when(F.col("o_orderkey") % 5 == 1, "flagged_low_row_count").when(F.col("o_orderkey") % 5 == 2, "flagged_partial_list").otherwise("applied")
    rows = o.select(F.col("o_orderkey").alias("import_id"), status.alias("status"), (F.col("o_orderstatus") == "F").alias("approved"), (F.col("o_orderpriority") == "1-URGENT").alias("rejected"))
    return rows.where(~F.col("approved") & ~F.col("rejected") & F.col("status").isin("failed", "flagged_low_row_count", "flagged_unparseable")).select("import_id", "status")


def suppliers_report(spark, sf_dir) -> DataFrame:
    """Live lots of each supplier by grade, with those that lack something: counts under conditions."""
    rows = lots(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_acctbal"), "supplier")
    return rows.groupBy("supplier").agg(F.count("*").alias("lots"), F.count_if(F.col("grade") == "A").alias("grade_a"), F.count_if(F.col("quantity") > 100).alias("large"), F.max((F.col("s_acctbal") < 0).cast("int")).alias("in_debt"))


def methods_report(spark, sf_dir) -> DataFrame:
    """How often each event type is met, and the mean of its value in hundredths, halves up."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.floor(F.sum(cents(F.col("value"))) / F.count("value") + F.lit(0.5)).cast("bigint").alias("mean_cents"))


def two_counts(spark, sf_dir) -> DataFrame:
    """Counts of two tables, one below the other."""
    one = lambda name, label: table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(label).alias("what"), "n")
    return one("orders", "deals").unionByName(one("lineitem", "legs"))


def usage_cost(spark, sf_dir) -> DataFrame:
    """Cost of each role's turns in millionths: tokens are words, each role with a rate of its own."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != ""))
    rate = F.when(F.col("role") == "user", 3).otherwise(15)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.sum((words * rate).cast("bigint")).alias("cost_e6"))


def browser_sorts(spark, sf_dir) -> DataFrame:
    """The ten first lots of each way to sort them; unknown values come last whatever the direction."""
    rows = lots(spark, sf_dir).select("supplier", "part", F.when(F.col("part") % 3 > 0, F.col("price_cents")).alias("price_cents"), "quantity", "seen_at", "description")
    ways = {"newest": F.col("seen_at").desc_nulls_last(), "cheapest": F.col("price_cents").asc_nulls_last(), "biggest": F.col("quantity").desc_nulls_last(), "name": F.lower("description").asc_nulls_last()}
    out = None
    for way, by in ways.items():
        some = rows.orderBy(by, "supplier", "part").limit(10).select(F.lit(way).alias("way"), "supplier", "part")
        out = some if out is None else out.unionByName(some)
    return out


def new_matches(spark, sf_dir) -> DataFrame:
    """Filled requirements first matched after an instant, newest first, at most 200."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'F')").where(F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp"))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "o_custkey")


def event_freshness(spark, sf_dir) -> DataFrame:
    """today, recent or stale for each event."""
    at = F.lit(NOW).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", deals.freshness(F.col("ts"), at).alias("freshness"))


def money_format(spark, sf_dir) -> DataFrame:
    """Prices with two digits and separators of thousands."""
    p = cents(F.col("p_retailprice")) * 37
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("€"), F.format_number(F.floor(p / 100).cast("bigint"), 0), F.lit("."), F.lpad((p % 100).cast("string"), 2, "0")).alias("shown"))


def timestamp_repair(spark, sf_dir) -> DataFrame:
    """Instants out of text with odd fractions and offsets; null for other text."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 4 == 0, F.concat(day, F.lit("T10:20:30.1234567Z"))).when(k % 4 == 1, F.concat(day, F.lit(" 10:20:30+02"))).when(k % 4 == 2, F.concat(day, F.lit("T10:20:30"))).otherwise("soon")
    repaired = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("T"), F.lit(" ")), r"\.(\d{6})\d+", ".$1"), r"([+-]\d{2})$", "$1:00")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(F.try_to_timestamp(repaired)).alias("epoch"))


def accepted_colours(spark, sf_dir) -> DataFrame:
    """The colours a buyer's line takes."""
    text = F.when(F.col("p_partkey") % 3 == 0, "iPhone 256GB blue / silver / orange").when(F.col("p_partkey") % 3 == 1, "Galaxy 128GB black").otherwise("Pixel rose gold, sky blue, mint x50")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(variants.accepted_colours(text), "|").alias("colours"))


NAMES = [
    lists_since, stored_board_filter, offer_search, review_queue, pending_imports, suppliers_report, methods_report, two_counts, usage_cost, browser_sorts, new_matches, event_freshness, money_format,
    timestamp_repair, accepted_colours,
]
QUERIES = {q.__name__: q for q in NAMES}


def oracle_sql(lots_: str) -> dict[str, str]:
    """SQL of the queries; lots_ is the WITH item of lots."""
    return {
        "lists_since": "select event_id, user_id, ts from events where event_type <> 'view' and ts >= timestamp '2024-01-10' qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 40",
        "stored_board_filter": f"with {lots_} select supplier, part, brand, description from lots where lower(brand) like 'brand#1%' and supplier in (3, 7, 11) and contains(lower(description), 'an') and contains(lower(description), 'e')",
        "offer_search": f"""with {lots_}, hit as (select * from lots where contains(lower(description), 'green') or contains(lower(brand), '#22') or contains(lower(category), 'plated nickel'))
          select supplier, part, (select count(*) from hit) as total from hit order by seen_at desc, supplier, part limit 500""",
        "review_queue": """select doc_id, case when doc_id % 7 = 0 and quality = 0 then 'both' when doc_id % 7 = 0 then 'sender' else 'classification' end as reason, substring(coalesce(text, ''), 1, 400) as preview
          from documents left join labels using (doc_id) where doc_id % 7 = 0 or quality = 0 order by doc_id desc limit 300""",
        "pending_imports": "select o_orderkey as import_id, case o_orderkey % 5 when 0 then 'failed' else 'flagged_low_row_count' end as status from orders where o_orderkey % 5 < 2 and o_orderstatus <> 'F' and o_orderpriority <> '1-URGENT'",
        "suppliers_report": f"with {lots_} select supplier, count(*) as lots, count(*) filter (where grade = 'A') as grade_a, count(*) filter (where quantity > 100) as large, max(cast(s_acctbal < 0 as int)) as in_debt from lots join supplier on s_suppkey = supplier group by 1",
        "methods_report": "select event_type, count(*) as n, cast(floor(sum(cast(floor(value * 100 + 0.5) as bigint)) / count(value) + 0.5) as bigint) as mean_cents from events group by 1",
        "two_counts": "select 'deals' as what, count(*) as n from orders union all select 'legs', count(*) from lineitem",
        "usage_cost": "select role, count(*) as calls, cast(sum(len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) * case role when 'user' then 3 else 15 end) as bigint) as cost_e6 from conversations group by 1",
        "browser_sorts": f"""with {lots_}, r as (select *, case when part % 3 > 0 then price_cents end as price from lots)
          (select 'newest' as way, supplier, part from r order by seen_at desc nulls last, supplier, part limit 10) union all (select 'cheapest', supplier, part from r order by price nulls last, supplier, part limit 10)
          union all (select 'biggest', supplier, part from r order by quantity desc nulls last, supplier, part limit 10) union all (select 'name', supplier, part from r order by lower(description) nulls last, supplier, part limit 10)""",
        "new_matches": "select o_orderkey, o_custkey from orders where o_orderstatus in ('O', 'F') and o_orderdate > timestamp '1998-01-01' order by o_orderdate desc, o_orderkey limit 200",
        "event_freshness": "select event_id, case when (epoch(timestamp '2024-02-01') - floor(epoch(ts))) / 3600 <= 24 then 'today' when (epoch(timestamp '2024-02-01') - floor(epoch(ts))) / 3600 <= 72 then 'recent' else 'stale' end as freshness from events",
        "money_format": "with p as (select p_partkey, 37 * cast(floor(p_retailprice * 100 + 0.5) as bigint) as c from part) select p_partkey, '€' || format('{:,}', c // 100) || '.' || lpad(cast(c % 100 as varchar), 2, '0') as shown from p",
        "timestamp_repair": """select o_orderkey, cast(case o_orderkey % 4 when 3 then null else epoch(date_trunc('day', cast(o_orderdate as timestamp))) + 10 * 3600 + 20 * 60 + 30 - case o_orderkey % 4 when 1 then 7200 else 0 end end as bigint) as epoch from orders""",
        "accepted_colours": "select p_partkey, case p_partkey % 3 when 0 then 'Blue|Silver|Orange' when 1 then '' else 'Gold|Sky Blue|Mint' end as colours from part",
    }
