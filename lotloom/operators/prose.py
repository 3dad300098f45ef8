"""Offers and requests written as lines of a message rather than as a table.

Lines are rows with their number. What a line means can hang on those before it: a brand alone is
a heading until the next one, and nothing counts after the sign-off. Both are windows over the lines of a
message; all else is a projection of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as n
from ..functions import product as p
from ..functions import variants
from ..functions import wording as w

# Fixed patterns: words that name a product, a count set apart from the line, how a message ends, values between asterisks.
PRODUCT = (
    r"(?i)\b(?:\d{2,4}\s?(?:gb|tb)|\d+/\d+\s?gb|iphone|ipad|macbook|airpods|galaxy|pixel|xperia|redmi|poco|moto|razr|nord|find\s?x|reno|quest|playstation|ps5|switch|xbox|"
    r"[as]\d{2,3}(?:\s?(?:ultra|plus|fe|\+))?|z\s?fold\d?|z\s?flip\d?)\b"
)
LEADING_COUNT = r"^(\d{1,6})(?:\t+|\s{2,})(?=\S)"
UNITS_OF = r"(?i)^(\d{1,6})\s*(?:units?|pcs?|pieces?)\b\s*(?:of\s+)?"
SIGN_OFF = r"(?i)^(?:kind|best|warm)?\s*regards\b|^thanks?\b|^thank you\b|^cheers\b|^br,?$"
MARKER = r"\*\s*([^*]{1,24}?)\s*\*"
MONEY_MARK = r"(?i)[€$£]|\b(?:eur|usd|gbp)\b"
SHORT_IPHONE = r"^(?:1[1-9]|[2-9])\b"
#: Shortest line of an offer and of a request, most words of a request, most units.
OFFER_LENGTH, REQUEST_LENGTH, REQUEST_WORDS, MOST_UNITS = 8, 3, 14, 100_000


def names_product(text: Column) -> Column:
    """Whether a line names a product by a model word or a capacity."""
    return F.coalesce(text.rlike(PRODUCT), F.lit(False))


def stripped(text: Column, marks: str) -> Column:
    """``text`` without these marks at either end."""
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def lines(messages: DataFrame, key: list[str], body: str) -> DataFrame:
    """(key, number, raw): the lines of each body, from 1."""
    each = F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), r"\R"))
    return messages.select(*key, each.alias("number", "raw")).withColumn("number", F.col("number") + 1)


def _spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"\s{2,}", " ")


def marked_quantity(text: Column) -> Column:
    """The first whole number between asterisks that is not marked as money."""
    inner = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    counts = F.filter(inner, lambda x: ~x.rlike(MONEY_MARK) & x.rlike(r"^\d{1,9}$") & x.try_cast("bigint").between(1, MOST_UNITS))
    return F.get(counts, F.lit(0)).cast("int")


def offers(messages: DataFrame, key: list[str], body: str, hint: str | None = None) -> DataFrame:
    """(key, number, variant, description, colour, quantity, price, currency, incoterm, price_basis, source_ref) of each line in
    which something is marked as money; a line of several colours or models is as many offers.
    """
    rows = lines(messages, key, body).withColumn("line", stripped(F.col("raw"), " •\\t-")).where(F.length("line") >= OFFER_LENGTH).drop("raw")
    rows = variants.expanded(rows, "line")
    text = F.col("variant")
    clean = stripped(_spaced(F.regexp_replace(text, MARKER, " ")), " –—-")
    rows = rows.withColumn("price", n.find_price(text, hint)).where("price is not null")
    rows = rows.withColumn("description", p.without_prices(F.when(clean == "", text).otherwise(clean)))
    return rows.select(
        *key, "number", "variant", "description", F.col("variant_colour").alias("colour"), F.coalesce(marked_quantity(text), n.quantity(F.col("description"))).alias("quantity"), "price",
        n.currency(text).alias("currency"), n.incoterm(text).alias("incoterm"), n.price_basis(text).alias("price_basis"), F.concat(F.lit("body line "), F.col("number").cast("string")).alias("source_ref"),
    )


def requests(messages: DataFrame, key: list[str], body: str) -> DataFrame:
    """(key, number, description, quantity, brand, source_ref) of each line that names a product, up to the sign-off.

    A count is taken only where the line sets it apart: before a wide gap, as units or pieces, or as ``quantity`` reads it.
    Under a heading a line without a brand gets the heading's, and a bare number under Apple is an iPhone.
    """
    line, raw = F.col("line"), F.col("raw")
    rows = lines(messages, key, body).withColumn("line", stripped(raw, " •\\t*-")).where("line <> ''")
    ordered = Window.partitionBy(*key).orderBy("number")
    rows = rows.withColumn("over", F.max(F.coalesce(line.rlike(SIGN_OFF), F.lit(False))).over(ordered)).where("not over")
    words = F.size(F.split(F.trim(F.regexp_replace(line, r"(?U)\s+", " ")), " "))
    rows = rows.withColumns({"brand": w.brand(line), "signal": names_product(line), "words": words})
    is_heading = (F.col("words") <= 2) & F.col("brand").isNotNull() & ~F.col("signal")
    rows = rows.withColumn("heading", F.last(F.when(is_heading, F.col("brand")), ignorenulls=True).over(ordered)).where(~is_heading)
    rows = rows.where((F.length("line") >= REQUEST_LENGTH) & (F.col("words") <= REQUEST_WORDS) & (F.col("brand").isNotNull() | F.col("signal")))
    bare = stripped(raw, " •*-")
    units, lead = line.rlike(UNITS_OF), bare.rlike(LEADING_COUNT)
    count = F.when(units, F.regexp_extract(line, UNITS_OF, 1).try_cast("bigint")).when(lead, F.regexp_extract(bare, LEADING_COUNT, 1).try_cast("bigint")).otherwise(n.quantity(line).cast("bigint"))
    said = F.when(units, F.trim(F.regexp_replace(line, UNITS_OF, ""))).when(lead, F.trim(F.regexp_replace(bare, LEADING_COUNT, ""))).otherwise(line)
    rows = rows.withColumns({"quantity": F.when(count.between(1, MOST_UNITS), count.cast("int")), "said": said})
    under = F.col("brand").isNull() & F.col("heading").isNotNull()
    named = F.concat_ws(" ", F.col("heading"), F.when((F.col("heading") == "Apple") & F.col("said").rlike(SHORT_IPHONE), F.lit("iPhone")), F.col("said"))
    return rows.select(*key, "number", F.when(under, named).otherwise(F.col("said")).alias("description"), "quantity", F.coalesce("brand", "heading").alias("brand"), F.concat(F.lit("body line "), F.col("number").cast("string")).alias("source_ref"))


def named_any(messages: DataFrame, key: list[str], subject: str, body: str) -> DataFrame:
    """(key, names_product): whether a message names any product, in an offer, a request or its subject; of others a person need not be asked."""
    found = offers(messages, key, body).select(*key).unionByName(requests(messages, key, body).select(*key)).distinct().withColumn("found", F.lit(True))
    return messages.join(found, key, "left").select(*key, (F.coalesce("found", F.lit(False)) | names_product(F.coalesce(F.col(subject), F.lit("")))).alias("names_product"))
