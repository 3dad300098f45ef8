"""Queries over offers and requests in running text: messages composed around the conversations' own texts; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import prose
from ..sources.tables import cents, table

# Bodies of offers by turn, {0} for a number of the message, and what each line says: line, description, colour, quantity, price in cents, currency,
# incoterm, basis. The conversation's text follows as a line of its own.
OFFERS = [
    ("Good day\n• A57 5G DS 8/128GB *{0}* Navy *259€*\n- Pixel 9 128GB 905 USD EXW\nshort €5", [
        (2, "A57 5G DS 8/128GB Navy", None, "{0}", 25900, "EUR", None, "unknown"), (3, "Pixel 9 128GB EXW", None, None, 90500, "USD", "EXW", "unknown"), (4, "short", None, None, 500, "EUR", None, "unknown"),
    ]),
    ("A17 LTE DS 4+128 — Black / Blue — €125\n\nno price here 300 units\n€437,90 each for iPhone 15", [
        (1, "A17 LTE DS 4+128 — Black", "Black", None, 12500, "EUR", None, "unknown"), (1, "A17 LTE DS 4+128 — Blue", "Blue", None, 12500, "EUR", None, "unknown"), (4, "each for iPhone 15", None, None, 43790, "EUR", None, "per_unit"),
    ]),
    ("The price is on request\r\n50 units *x* of nothing", []),
]
# Bodies of requests, and what each line asks for: line, description, quantity, brand. The conversation's text follows the sign-off.
REQUESTS = [
    ("Hello,\nPlease quote:\n{0}\tGoogle Pixel 10 Pro 256GB\n50x iPhone 15 128GB Black\nKind regards\n200 units of Moto G55", [(3, "Google Pixel 10 Pro 256GB", "{0}", "Google"), (4, "50x iPhone 15 128GB Black", "50", "Apple")]),
    ("Apple\n16 128gb mix colours\n\n* 15 pro max 256gb\nSamsung\n{0}  S24 FE 128GB\nAll specs welcomed\nThanks\nApple iPhone 13", [
        (2, "Apple iPhone 16 128gb mix colours", None, "Apple"), (4, "Apple iPhone 15 pro max 256gb", None, "Apple"), (6, "Samsung S24 FE 128GB", "{0}", "Samsung"),
    ]),
    ("{0} units of Moto G55 8/256GB\n- 5 pcs PlayStation 5\n900000 pcs Xperia 1\nBR,", [(1, "Moto G55 8/256GB", "{0}", "Motorola"), (2, "PlayStation 5", "5", "Sony"), (3, "Xperia 1", None, "Sony")]),
    ("All specs welcomed\nCall us on 00 44 555\nbest regards\niPhone 13 128GB", []),
]


def _bodies(spark, sf_dir, texts: list[str], end: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    body = F.replace(F.get(F.array(*map(F.lit, texts)), (k % len(texts)).cast("int")), F.lit("{0}"), (F.col("conv_id") % 50 + 1).cast("string"))
    return rows.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("body", F.concat(body, F.lit(end), F.coalesce("text", F.lit("")))).withColumn("subject", F.when(F.col("conv_id") % 5 == 0, "Stock of Galaxy Z Fold5").otherwise("hello"))


def prose_offers(spark, sf_dir) -> DataFrame:
    """Every line of every message that offers something for money."""
    rows = prose.offers(_bodies(spark, sf_dir, [t for t, _ in OFFERS], "\n"), ["conv_id", "turn"], "body")
    return rows.select("conv_id", "turn", "number", "description", "colour", "quantity", cents(F.col("price")).alias("price_cents"), "currency", "incoterm", "price_basis", "source_ref")


def prose_requests(spark, sf_dir) -> DataFrame:
    """Every line of every message that asks for a product."""
    return prose.requests(_bodies(spark, sf_dir, [t for t, _ in REQUESTS], "\nCheers\n"), ["conv_id", "turn"], "body")


def prose_names_product(spark, sf_dir) -> DataFrame:
    """Whether each message names any product at all."""
    return prose.named_any(_bodies(spark, sf_dir, [t for t, _ in REQUESTS], "\nCheers\n"), ["conv_id", "turn"], "subject", "body")


QUERIES = {q.__name__: q for q in (prose_offers, prose_requests, prose_names_product)}


def _sql(x) -> str:
    return "null" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _said(bodies: list) -> str:
    return ", ".join(f"({k}, {', '.join(map(_sql, row))})" for k, (_, rows) in enumerate(bodies) for row in rows)


_MESSAGES = "messages as (select distinct conv_id, turn, cast(conv_id % 50 + 1 as varchar) as n from conversations)"
ORACLE_SQL = {
    "prose_offers": f"""with {_MESSAGES}, said(k, number, description, colour, quantity, price_cents, currency, incoterm, price_basis) as (values {_said(OFFERS)})
      select conv_id, turn, number, description, cast(colour as varchar) as colour, cast(replace(quantity, '{{0}}', n) as int) as quantity, cast(price_cents as bigint) as price_cents, currency, cast(incoterm as varchar) as incoterm, price_basis, 'body line ' || number as source_ref
      from messages join said on k = (conv_id + turn) % {len(OFFERS)}""",
    "prose_requests": f"""with {_MESSAGES}, said(k, number, description, quantity, brand) as (values {_said(REQUESTS)})
      select conv_id, turn, number, description, cast(replace(quantity, '{{0}}', n) as int) as quantity, brand, 'body line ' || number as source_ref from messages join said on k = (conv_id + turn) % {len(REQUESTS)}""",
    "prose_names_product": f"with {_MESSAGES} select conv_id, turn, (conv_id + turn) % {len(REQUESTS)} < 3 or conv_id % 5 = 0 as names_product from messages",
}
