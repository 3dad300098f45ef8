"""Queries over sheets of one message and over price columns, composed for each brand and supplier; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models
from ..functions import product as p
from ..operators import extract, mapping, sheets
from ..sources.shared import stored
from ..sources.tables import cents, lots, table


def _sheets(spark, sf_dir) -> DataFrame:
    """Two sheets for each brand: one by colour, and one by model. The latter totals all of the former, or half of it, or has colours itself."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("message"), F.expr("cast(substring(p_brand, 7) as int) % 3").alias("case"), cents(F.col("p_retailprice")).alias("price_cents"), (k % 7 + 1).alias("a"), (k % 5 + 2).alias("b"))
    text = F.concat(F.lit("Nokia C"), k.cast("string"), F.lit(" 128GB"))
    sheet = lambda name, colour, quantity, tail: part.where(k % 20 != tail).select("message", F.lit(name).alias("grid"), "p_partkey", text.alias("description"), "price_cents", F.when(k % 3 > 0, "eur").alias("currency"), colour.alias("colour"), quantity.cast("int").alias("quantity"))
    total = F.when(k % 10 == 0, None).when((F.col("case") == 1) & (k % 2 == 1), F.col("a") + F.col("b") + 1).otherwise(F.col("a") + F.col("b"))
    by_model = sheet("by model", F.when(F.col("case") == 2, "Grey"), total, -1)
    rows = sheet("by colour", F.lit("Black"), F.col("a"), 7).unionByName(sheet("by colour", F.lit("White"), F.col("b"), 7)).unionByName(by_model)
    line = F.col("description")
    return rows.withColumns({"description_key": models.description_key(line), "capacity_gb": p.memory(line)["capacity_gb"], "availability": F.lit(None).cast("string"), "grade": F.lit("").cast("string")})


def sheet_summaries(spark, sf_dir) -> DataFrame:
    """Which rows other sheets of their message cover, and which sheets are summaries."""
    return sheets.summary_coverage(_sheets(spark, sf_dir), "message", "grid").select("message", "grid", "p_partkey", "colour", "covered", "summary")


def sheet_rows(spark, sf_dir) -> DataFrame:
    """The rows and units of each message that are left without summaries."""
    return sheets.without_summaries(_sheets(spark, sf_dir), "message", "grid").groupBy("message", "grid").agg(F.count("*").alias("n"), F.sum("quantity").alias("units"))


def bare_prices(spark, sf_dir) -> DataFrame:
    """Price and currency of each lot whose list heads its column only "Price": told by the columns beside it, or taken from one of them."""
    c, case = F.col("price_cents"), F.col("supplier") % 5
    text = lambda x: F.concat(F.floor(x / 100).cast("string"), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))
    of = lambda code, x: F.struct(F.lit(code).alias("code"), text(x).alias("price"))
    others = F.when(case == 0, F.array(of("EUR", F.floor(c * 119 / 100)), of("USD", F.floor(c * 135 / 100)))).when(case == 1, F.array(of("USD", F.floor(c * 110 / 100)), of("EUR", c)))
    others = others.when(case == 2, F.array(of("USD", F.floor(c * 122 / 100)))).when(case == 3, F.array(of("GBP", F.floor(c * (60 + F.col("part") % 40) / 100)), of("EUR", F.floor(c * 300 / 100)))).otherwise(F.array(of("GBP", F.floor(c * 86 / 100))))
    rows = lots(spark, sf_dir).where("price_cents > 0")
    at = F.row_number().over(Window.partitionBy("supplier").orderBy("part")) - 1
    cells = rows.select("supplier", "part", at.alias("n"), text(c).alias("price"), others.alias("others"))
    return sheets.priced(cells, "supplier").select("supplier", "part", cents(F.col("amount")).alias("price_cents"), "currency", "how")


# Header cells of a list, by remainder of its brand's number; without any the columns are told by their cells.
HEADS = [["", "EAN", "Price", "Quantity"], ["", "Notice", "", "Price €"], None, None, ["Product", "", "Price", "x"]]


def headless_rows(spark, sf_dir) -> DataFrame:
    """Lists whose header leaves the product blank, names one column alone, is not there at all, or names codes as the product."""
    k, case = F.col("p_partkey"), F.expr("cast(substring(p_brand, 7) as int) % 5")
    text, c = F.concat(F.lit("Nokia C"), k.cast("string"), F.lit(" 128GB")), cents(F.col("p_retailprice"))
    money = F.format_string("%d.%02d", F.floor(c / 100).cast("bigint"), c % 100)
    shapes = [F.array(text, F.lpad(k.cast("string"), 13, "4"), money, (k % 7 + 1).cast("string")), F.array(text, F.lit("as is"), F.lit(""), money), F.array(text, money), F.array(money, text, F.lit("-")), F.array(k.cast("string"), text, money, F.lit("-"))]
    cells = F.when(case == 0, shapes[0])
    for n_, shape in enumerate(shapes[1:], 1):
        cells = cells.when(case == n_, shape)
    part = table(spark, sf_dir, "part")
    body = part.select(F.col("p_brand").alias("key"), F.lit("list").alias("source"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("row_idx"), cells.alias("cells"))
    head = F.get(F.array(*[F.array(*map(F.lit, h)) if h else F.lit(None).cast("array<string>") for h in HEADS]), case)
    heads = part.select(F.col("p_brand").alias("key"), F.lit("list").alias("source"), F.lit(0).alias("row_idx"), head.alias("cells")).distinct().where("cells is not null")
    rows = extract.extract_rows(heads.unionByName(body))
    return rows.select("key", "description", "ean", "quantity", cents(F.col("price")).alias("price_cents"), "currency", "source_ref")


# What an outside reader says of each list's four unnamed columns, by remainder of its brand's number; the last is not answered.
ANSWERS = [
    [("description", 1), ("price", 2), ("quantity", 3), ("nonsense", 0)], [("description", 1), ("price", 2), ("ean", 0), ("quantity", 1)], [("description", 1), ("price", 2), ("ean", 3)], [("description", 1), ("price", 0)], [("description", 2), ("price", 1)], None,
]


def column_answers(spark, sf_dir) -> DataFrame:
    """Lists with a header nobody knows, answers about them, and what of these the cells bear out."""
    k, case = F.col("p_partkey"), F.expr(f"cast(substring(p_brand, 7) as int) % {len(ANSWERS)}")
    part = table(spark, sf_dir, "part")
    body = part.select(F.col("p_brand").alias("key"), F.lit("list").alias("source"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("row_idx"), F.array(F.lit("n/a"), F.concat(F.lit("Nokia C"), k.cast("string"), F.lit(" 128GB")), F.format_string("%d.50", k), (k % 7 + 1).cast("string")).alias("cells"))
    heads = part.select(F.col("p_brand").alias("key"), F.lit("list").alias("source"), F.lit(0).alias("row_idx"), F.array(F.lit("Zaa"), F.concat(F.lit(" Zbb "), F.chr(case + 97)), F.lit("ZCC"), F.lit("")).alias("cells")).distinct()
    grid = stored(heads.unionByName(body), "grid")
    read = extract.headers(grid.withColumn("named", F.transform("cells", extract.header_field)).withColumn("distinct", F.size(F.array_compact(F.array_distinct("named")))))
    tables = stored(mapping.unread(grid, read), "unread")
    known = spark.createDataFrame([], "signature string, fields map<string,int>")
    rows = [(f"4:zaa|zbb {chr(97 + n)}|zcc|", [{"field": f, "at": at} for f, at in answer]) for n, answer in enumerate(ANSWERS) if answer]
    answers = mapping.to_ask(tables, known).select("signature").join(spark.createDataFrame(rows, "signature string, answer array<struct<field: string, at: int>>"), "signature")
    got = mapping.judged(tables, answers)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), " ")
    return tables.join(got.select("key", "verdict", "fields"), "key", "left").select("key", "signature", F.coalesce("verdict", F.lit("open")).alias("verdict"), text.alias("fields"))


QUERIES = {q.__name__: q for q in (column_answers, headless_rows, sheet_summaries, sheet_rows, bare_prices)}

_ROWS = """r as (select p_partkey as k, p_brand as message, cast(substring(p_brand, 7) as int) % 3 as c, p_partkey % 7 + 1 as a, p_partkey % 5 + 2 as b from part),
  m as (select *, c < 2 and k % 20 <> 7 and (k % 10 = 0 or c = 0 or k % 2 = 0) as covered from r),
  s as (select message, count(*) filter (where covered) >= 3 and count(*) filter (where covered) >= 0.6 * count(*) as summary from m group by 1)"""


def oracle_sql(lots_: str) -> dict[str, str]:
    return {
        "column_answers": """with said(c, verdict, fields) as (values (0, 'accepted', 'description:1 price:2 quantity:3'), (1, 'half', 'description:1 price:2'), (2, 'half', 'description:1 price:2'), (3, 'refused', null), (4, 'refused', null), (5, 'open', null))
          select p_brand as key, '4:zaa|zbb ' || chr(97 + c) || '|zcc|' as signature, verdict, fields from (select distinct p_brand, cast(substring(p_brand, 7) as int) % 6 as c from part group by p_brand having count(*) >= 2) join said using (c)""",
        "headless_rows": """with r as (select p_brand as key, p_partkey as k, cast(substring(p_brand, 7) as int) % 5 as c, cast(floor(p_retailprice * 100 + 0.5) as bigint) as cents, row_number() over (partition by p_brand order by p_partkey) as i, count(*) over (partition by p_brand) as n from part)
          select key, 'Nokia C' || k || ' 128GB' as description, case when c = 0 then lpad(cast(k as varchar), 13, '4') end as ean, cast(case when c = 0 then k % 7 + 1 end as int) as quantity, cents as price_cents, case when c = 1 then 'EUR' end as currency, 'list row ' || (i + 1) as source_ref
          from r where n >= case when c in (2, 3) then 4 when c = 4 then 3 else 2 end""",
        "sheet_summaries": f"""with {_ROWS} select message, 'by colour' as grid, k as p_partkey, colour, false as covered, false as summary from r, (values ('Black'), ('White')) t(colour) where k % 20 <> 7
          union all select m.message, 'by model', k, case when c = 2 then 'Grey' end, covered, summary from m join s using (message)""",
        "sheet_rows": f"""with {_ROWS}, x as (select message, 'by colour' as grid, q from (select message, unnest([a, b]) as q from r where k % 20 <> 7)
          union all select m.message, 'by model', case when k % 10 = 0 then null when c = 1 and k % 2 = 1 then a + b + 1 else a + b end from m join s using (message) where not (covered and summary))
          select message, grid, count(*) as n, cast(sum(q) as bigint) as units from x group by 1, 2""",
        "bare_prices": f"""with {lots_}, t as (select supplier, part, price_cents as c, supplier % 5 as k, count(*) over (partition by supplier) > 1 as enough from lots where price_cents > 0)
          select supplier, part, case when k = 2 or (k = 0 and not enough) then case k when 2 then c * 122 // 100 else c * 119 // 100 end when k = 3 then c * (60 + part % 40) // 100 when k in (1, 4) and not enough then case k when 1 then c * 110 // 100 else c * 86 // 100 end else c end as price_cents,
                 case k when 0 then case when enough then 'GBP' else 'EUR' end when 1 then case when enough then 'EUR' else 'USD' end when 2 then 'USD' when 3 then 'GBP' else case when enough then 'EUR' else 'GBP' end end as currency,
                 case when not enough or k in (2, 3) then 'switched' when k = 1 then 'equal' else 'band' end as how from t""",
    }
