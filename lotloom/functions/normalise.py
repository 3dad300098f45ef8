"""What a cell or a line of a list says, as column expressions: money, quantity, codes, brand, side.

Each function takes a string column and is null where the text does not say. All run inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency codes, symbols and trade words.
CODES = ["AED", "AUD", "BRL", "CAD", "CHF", "CNY", "EUR", "GBP", "HKD", "INR", "JPY", "KRW", "KWD", "QAR", "RUB", "SAR", "SGD", "TRY", "USD", "ZAR"]
SYMBOLS = {"€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "د.إ": "AED", "₩": "KRW"}
WORDS = {
    "usd": "USD", "dollars": "USD", "dollar": "USD", "us$": "USD", "usd$": "USD", "dirham": "AED", "dirhams": "AED", "aed": "AED", "dhs": "AED", "dh": "AED",
    "euro": "EUR", "euros": "EUR", "pound": "GBP", "pounds": "GBP", "sterling": "GBP", "gbp": "GBP", "yuan": "CNY", "rmb": "CNY",
    "rupee": "INR", "rupees": "INR", "inr": "INR", "yen": "JPY",
}
# Delivery terms, in the order they are looked for.
INCOTERMS = ["EXW", "FCA", "FOB", "CIF", "CFR", "CPT", "CIP", "DAP", "DPU", "DDP", "DDU"]
# Fixed patterns of price basis and tax.
PER_LOT = r"(?i)\b(?:per\s*lot|for\s*the\s*lot|lot\s*price|total\s*price|whole\s*lot|job\s*lot)\b"
PER_UNIT = r"(?i)\b(?:per\s*(?:unit|pc|pcs|piece|pieces|ea|each|handset|phone)|/\s*(?:pc|pcs|unit|ea)|ea\b|each\b)"
VAT_EXCLUDED = r"(?i)(?:excl?\w*\.?\s*(?:of\s+)?vat|vat\s+excl\w*|\bex\s+vat|\bno\s+vat|\bplus\s+vat|\+\s*vat)"
VAT_INCLUDED = r"(?i)(?:incl?\w*\.?\s*(?:of\s+)?vat|vat\s+incl\w*|\bwith\s+vat)"
# Fixed pattern of a number that something marks as money; the number is in one of three groups.
MARKED = (
    r"(?i)[€$£]\s*(\d+(?:[.,]\d+)*)"
    r"|(\d+(?:[.,]\d+)*)(?:[.,]\s?[-–—])?\s*[€$£](?!\s*\d)"
    r"|(\d+(?:[.,]\d+)*)(?:[.,]\s?[-–—])?\s*(?:EUR|USD|GBP|AED|PLN|CHF|SEK|CZK)\b"
)
# Fixed patterns of a quantity, the first that is found counts; the number is in group 1.
QUANTITY = [
    r"(?i)\bqty\.?\s*[:=]?\s*(\d{1,6})\b",
    r"(?i)\bquantity\s*[:=]?\s*(\d{1,6})\b",
    r"(?i)\b(\d{1,6})\s*(?:pcs?|pieces?|units?|handsets?|nos?)\b",
    r"(?i)\b(\d{1,6})\s*[x×]\s*(?=[a-z])",
    r"(?i)\b(\d{1,6})\s?[x×](?=\s|,|;|$)",
    r"(?:^|\s)(?:x|×)\s*(\d{1,6})\b",
    r"\sX\s*(\d{1,6})\s*[.,;!]?\s*$",
]
MOST_UNITS = 100_000
# Fixed patterns of wording that offers or asks.
BUY = (
    r"(?i)\b(?:wtb|want\s*to\s*buy|we\s*(?:want|need|are\s*looking)\s*to\s*buy|buying|we\s*buy|purchase\s*(?:request|list)|request\s*(?:for\s*)?(?:offer|quotation|price)|rfq|"
    r"send\s*(?:us\s*)?your\s*(?:best\s*)?(?:offer|price)|looking\s*for|suche|ankauf|einkauf|zoeken|poszukuj)\b"
)
SELL = (
    r"(?i)\b(?:wts|want\s*to\s*sell|we\s*sell|for\s*sale|selling|price\s*list|pricelist|preisliste|prijslijst|listino|lista\s*de\s*precios|"
    r"stock\s*(?:list|sheet|offer)|lagerliste|lagerbestand|our\s*(?:offer|stock|availability)|available\s*stock|verkauf|angebot)\b"
)
SELL_NOUN = r"(?i)\b(?:offer|offers|offering|offerta|offerte|oferta|aanbod)\b"
BUY_NOUN = r"(?i)\b(?:request|requests|enquiry|inquiry|wanted|anfrage|richiesta)\b"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def once(value: Column, read: Callable[[Column], Column]) -> Column:
    """``read`` of a value that is worked out once for a row, however often ``read`` names it."""
    return F.transform(F.array(value), read)[0]


def _first(options: list[Column]) -> Column:
    return F.coalesce(*options)


def number(token: Column, hint: str | None = None) -> Column:
    """A token of digits and separators as a double; ``hint`` names a supplier's decimal sign (comma or dot).

    With both signs the one further right is decimal. One sign that repeats, or has three digits
    behind it, groups thousands; else it is decimal.
    """
    return once(token, lambda t: _number(t, hint))


def _number(token: Column, hint: str | None) -> Column:
    dot, comma = F.instr(token, "."), F.instr(token, ",")
    bare = lambda sign: F.replace(token, F.lit(sign), F.lit(""))
    as_dot = bare(",")
    as_comma = F.replace(bare("."), F.lit(","), F.lit("."))
    both = F.when(F.length(F.substring_index(token, ".", -1)) < F.length(F.substring_index(token, ",", -1)), as_dot).otherwise(as_comma)
    none = F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit(""))
    if hint == "comma":
        one = F.when(comma > 0, as_comma).otherwise(none)
    elif hint == "dot":
        one = F.when(dot > 0, as_dot).otherwise(none)
    else:
        signs, behind = F.length(token) - F.length(none), F.least(*[F.length(F.substring_index(token, sign, -1)) for sign in (".", ",")])
        one = F.when((signs > 1) | (behind == 3), none).otherwise(F.when(dot > 0, as_dot).otherwise(as_comma))
    text = F.when((dot > 0) & (comma > 0), both).when((dot == 0) & (comma == 0), token).otherwise(one)
    return text.try_cast("double")


def parse_price(text: Column, hint: str | None = None) -> Column:
    """The first number of a price cell; a barcode of 8 or 12 to 14 digits is no price."""
    token = F.nullif(F.regexp_extract(text, r"(\d+(?:[.,]\d+)*)", 1), F.lit(""))
    return once(token, lambda t: F.when(~t.rlike(r"^(?:\d{8}|\d{12,14})$"), _number(t, hint)))


def find_price(text: Column, hint: str | None = None) -> Column:
    """The last number of a line that a symbol or code marks as money."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(MARKED), F.lit(0)), F.lit(-1))
    return number(found(last, r"(\d+(?:[.,]\d+)*)"), hint)


def currency(text: Column, default: str | None = None) -> Column:
    """ISO code: a code in the text, the earliest if there are several, else a symbol, a trade word, or
    the supplier's default for a bare dollar sign."""
    codes = found(F.upper(text), rf"\b({'|'.join(CODES)})\b")
    symbols = [F.when(F.contains(text, F.lit(s)), F.lit(c)) for s, c in SYMBOLS.items()]
    words = [F.when(F.lower(text).rlike(rf"(?<![a-z])\Q{w}\E(?![a-z])"), F.lit(c)) for w, c in WORDS.items()]
    bare = F.when(F.contains(text, F.lit("$")), F.lit(default).cast("string"))
    return F.when(text.rlike(r"[^\d\s.,]"), _first([codes, *symbols, *words, bare]))  # a bare number names none


def price_basis(text: Column) -> Column:
    """per_lot, per_unit or unknown."""
    return F.when(text.rlike(PER_LOT), "per_lot").when(text.rlike(PER_UNIT), "per_unit").otherwise("unknown")


def incoterm(text: Column) -> Column:
    """The first delivery term of the list that stands in the text."""
    return _first([F.when(F.upper(text).rlike(rf"\b{t}\b"), F.lit(t)) for t in INCOTERMS])


def vat_included(text: Column) -> Column:
    """False where tax is said to be excluded, true where included, else null."""
    return F.when(text.rlike(VAT_EXCLUDED), False).when(text.rlike(VAT_INCLUDED), True)


def quantity(text: Column) -> Column:
    """Units: marked as such in a line, or a whole cell like 40, 1,000, 1.5k, 200x, 50+ or min 50."""
    return once(text, lambda t: once(F.regexp_replace(t, r"(?i)\b\d{1,4}\s*(?:gb|tb)\b", " "), lambda line: _quantity(t, line)))


def _quantity(text: Column, line: Column) -> Column:
    sane = lambda n: F.when((n > 0) & (n <= MOST_UNITS), n.cast("int"))
    marked = [sane(found(line, p).cast("bigint")) for p in QUANTITY]
    alone = sane(found(F.trim(line), r"^(\d{1,6})$").cast("bigint"))
    cell = F.trim(text)
    thousands = F.when(cell.rlike(r"^\d{1,3}(?:[.,  ]\d{3})+$"), F.regexp_replace(cell, r"\D", "").cast("bigint"))
    kilo = F.bround(F.replace(found(cell, r"(?i)^(\d{1,3}(?:[.,]\d{1,3})?)\s*k$"), F.lit(","), F.lit(".")).cast("double") * 1000).cast("bigint")
    times = _first([found(cell, r"(?i)^[x×]\s*(\d{1,6})$"), found(cell, r"(?i)^(\d{1,6})\s*[x×]$")]).cast("bigint")
    least = F.when(cell.rlike(r"(?i)[+>]|min"), found(cell, r"^(?:>\s*|min\.?\s*)?(\d{1,6})\s*\+?$").cast("bigint"))
    return _first([*marked, alone, sane(_first([thousands, kilo, times, least]))])


def ean(text: Column) -> Column:
    """A barcode cell as 8 or 13 digits: 14 with a leading 0 lose it, 12 get one."""
    digits = F.regexp_replace(found(text, r"^(\D{0,2}(?:\d{8}|\d{12,14})\D{0,2})$"), r"\D", "")
    n = F.length(digits)
    return F.when(n.isin(8, 13), digits).when(n == 12, F.concat(F.lit("0"), digits)).when((n == 14) & digits.startswith("0"), F.substring(digits, 2, 13))


def is_wordy(text: Column) -> Column:
    """Six characters or more, at least four letters, and more than two in five of them letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (F.length(text) >= 6) & (letters >= 4) & (letters / F.length(text) > 0.4)


def classify_side(subject: Column, body: Column) -> Column:
    """struct(side, confidence, needs_review) of a message: sell, buy or null.

    A marker in the subject decides, then its noun; else the counts of markers in the first 2000
    characters of the body.
    """
    subject, head = F.coalesce(subject, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 2000)
    s_buy, s_sell = subject.rlike(BUY), subject.rlike(SELL)
    n_buy, n_sell = subject.rlike(BUY_NOUN), subject.rlike(SELL_NOUN)
    b_buy, b_sell = F.regexp_count(head, F.lit(BUY)), F.regexp_count(head, F.lit(SELL))

    def said(side: str | None, confidence: float, review: bool) -> Column:
        return F.struct(F.lit(side).cast("string").alias("side"), F.lit(confidence).alias("confidence"), F.lit(review).alias("needs_review"))

    neither, both = ~s_buy & ~s_sell, s_buy & s_sell
    rules = [
        (s_buy & ~s_sell, said("buy", 0.95, False)), (s_sell & ~s_buy, said("sell", 0.95, False)),
        (neither & n_sell & ~n_buy, said("sell", 0.9, False)), (neither & n_buy & ~n_sell, said("buy", 0.9, False)),
        (both & (b_buy > b_sell), said("buy", 0.6, True)), (both & (b_sell > b_buy), said("sell", 0.6, True)), (both, said(None, 0.0, True)),
        ((b_buy > 0) & (b_sell == 0), said("buy", 0.7, False)), ((b_sell > 0) & (b_buy == 0), said("sell", 0.7, False)),
        (b_sell > b_buy, said("sell", 0.6, True)), (b_buy > b_sell, said("buy", 0.6, True)),
    ]
    return reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0])).otherwise(said(None, 0.0, True))


def identity_key(ean_: Column, brand: Column, description_key: Column, capacity: Column, *qualifiers: Column) -> Column:
    """ean:{ean}|q, or spec:{brand}|{description}|q without a barcode; q joins capacity and the
    qualifiers (colour, edition, part, grade, region, availability) in lower case, empty for null."""
    text = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    q = F.concat_ws("|", text(capacity), *map(text, qualifiers))
    spec = F.concat(F.lit("spec:"), text(brand), F.lit("|"), text(description_key), F.lit("|"), q)
    return F.when(ean_.isNotNull(), F.concat(F.lit("ean:"), ean_, F.lit("|"), q)).otherwise(spec)
