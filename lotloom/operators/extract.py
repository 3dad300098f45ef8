"""Rows of a list out of a grid: header, sections, fields. All of it is DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as n
from ..sources.shared import stored
from ..sources.tables import spread

# What a header cell says, by field.
ALIASES = {
    "description": [
        "description", "descriptions", "artikelbezeichnung", "bezeichnung", "modell", "model", "models", "product", "produkt", "produkte", "descrizione", "descripcion",
        "omschrijving", "item", "items", "article", "articolo", "nazwa", "opis", "denumire", "produs", "designation", "typ", "type", "name",
    ],
    "ean": ["ean", "eannummer", "ean nummer", "gtin", "barcode", "barcodes", "kod ean", "codice ean"],
    "quantity": [
        "qty", "quantity", "qty available", "available", "stock", "in stock", "lagerbestand", "lagerbestand qty", "bestand", "menge", "anzahl", "ready", "incoming", "disponibile",
        "disponibili", "quantita", "cantidad", "aantal", "voorraad", "ilosc", "stan", "stoc", "pcs", "pieces", "units",
    ],
    "price": [
        "price", "prices", "preis", "preise", "prezzo", "precio", "prix", "prijs", "cena", "pret", "unit price", "price eur", "prezzo eur", "preis price", "price exw", "exw",
        "netto", "net price", "vk", "ek",
    ],
    "brand": ["brand", "brands", "marke", "marca", "merk", "marka", "manufacturer", "hersteller", "producent", "make", "mfr", "mfg", "oem"],
    "grade": ["grade", "grades", "grading", "condition", "cond", "zustand", "stato", "klasa", "stan techniczny", "grade condition"],
    "region": ["spec", "region", "version", "market", "variant region", "specs region"],
    "code": [
        "code", "codes", "partcode", "part code", "part no", "part number", "p n", "pn", "item no", "item nr", "item number", "item code", "item id", "art no", "art nr",
        "article no", "article nr", "article number", "artikel nr", "artikelnr", "artikelnummer", "artnr", "sku", "mpn", "ref", "reference", "codice", "kod",
    ],
    "capacity": [
        "capacity", "capacities", "storage", "memory", "int memory", "internal memory", "rom", "speicher", "memoria", "capacita", "capacidad", "almacenamiento", "geheugen",
        "opslag", "pamiec", "pamiec wewnetrzna", "stocare",
    ],
    "ram": ["ram", "ram gb", "ram memory", "arbeitsspeicher", "memoria ram", "ram rom"],
    "category": ["category", "categories", "kategorie", "categoria", "categorie", "kategoria"],
    "currency": ["currency", "waehrung", "wahrung", "valuta", "moneda", "devise"],
    "colour": ["colour", "color", "colours", "colors", "farbe", "kleur", "colore", "kolor"],
    "notes": ["notes", "note", "obs", "remarks", "bemerkung", "specifications", "link"],
}
# Headers that are a currency alone, words that name a column only in a short cell, codes of the seller's own.
CURRENCY_ONLY = [
    "usd", "eur", "gbp", "aed", "pln", "chf", "czk", "huf", "ron", "sek", "€", "$", "£", "euro", "euros", "eur €", "€ eur", "usd $", "usd$", "$ usd", "us$", "us $", "dollar", "dollars",
    "us dollar", "gbp £", "£ gbp", "pound", "pounds", "sterling",
]
SHORT_ONLY = ["ram", "rom", "memory", "memoria", "storage", "speicher", "geheugen", "opslag"]
OWN_CODES = ["artikelnummer", "artnr", "art nr", "artikel nr", "artikel", "article number", "ref", "reference", "our ref", "internal", "internal code", "item no", "item number", "kod"]
# Fixed patterns: a heading of several words, and the currency that a header names.
HEADING = r"\b(?:brand new|new stock|stock uk|stock eu|spec|cpo|asis|as is|refurbished|pre owned|graded stock|used stock)\b"
HEADER_CURRENCY = [(r"€|\beur\b|\beuros?\b", "EUR"), (r"\$|\busd\b", "USD"), (r"£|\bgbp\b", "GBP"), (r"\baed\b|\bdhs?\b", "AED"), (r"\bpln\b|\bzł\b", "PLN")]
# Fixed patterns: stock on its way, stock on hand, and when.
INCOMING = r"(?i)\b(?:incoming|in[\s-]?transit|arriving|on\s+the\s+way|pre[\s-]?orders?|coming\s+soon|future\s+stock|eta)\b"
IN_STOCK = r"(?i)\b(?:in\s+stock|ready\s+stock|available\s+now|ex[\s-]?stock|on\s+hand|warehouse\s+stock)\b"
ETA = r"(?i)\beta\b[\s:.\-]*([0-9][^()\n]{0,30}?(?:days?|weeks?|wks?)\b|[^()\n]{1,30})"
# Fixed pattern of first words that are no product.
NOT_PRODUCT = r"(?i)^\s*(total|totale|gesamt|subtotal|sum|note|notes|remarks|terms|conditions|dear\s|kindly|please|thank|regards|www\.|http)"
#: Rows among which the header stands; distinct fields it needs; fields of a reprinted one.
HEAD_ROWS, HEAD_FIELDS, AGAIN_FIELDS = 30, 2, 3

GRID = ["key", "source"]
# Rows that a column is judged by, rows a partial header is looked for in, the share of cells that makes a column one of words or prices.
SAMPLE, PARTIAL_ROWS, WORDY = 40, 10, 0.7


def header_text(cell: Column) -> Column:
    """A header cell in lower case, without marks but those of currencies."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, r"[\n/_]", " "), r"(?U)[^\w\s€$£]", " "), r"\s+", " ")))


def header_field(cell: Column) -> Column:
    """The field that a header cell names, null for other text: the whole cell, then its words in turn, then a phrase in it."""
    return n.once(header_text(cell), lambda text: n.once(F.split(text, " "), lambda words: _field(text, words)))


def _field(text: Column, words: Column) -> Column:
    names = F.create_map(*[F.lit(x) for field, aliases in ALIASES.items() for w in aliases for x in (w, field)])
    by_word = F.transform(words, lambda w: F.when(~(w.isin(SHORT_ONLY) & (F.size(words) > 3)), F.try_element_at(names, w)))
    phrases = F.array(*[F.struct(F.lit(w).alias("phrase"), F.lit(field).alias("field")) for field, aliases in ALIASES.items() for w in aliases if " " in w])
    by_phrase = F.get(F.filter(phrases, lambda x: F.contains(text, x["phrase"])), F.lit(0))["field"]
    return F.when(text.rlike(r"[^\d ]"), F.coalesce(  # bare numbers name nothing
        F.when((F.size(words) >= 3) & text.rlike(HEADING), "description"), F.when(text.isin(CURRENCY_ONLY), "price"), F.try_element_at(names, text), F.get(F.array_compact(by_word), F.lit(0)), by_phrase,
    ))


def header_currency(cell: Column) -> Column:
    """The currency that a header cell names."""
    return F.coalesce(*[F.when(cell.rlike(f"(?iu){pattern}"), F.lit(code)) for pattern, code in HEADER_CURRENCY])


def mapped_columns(cells: Column) -> Column:
    """struct(fields, other_prices, currency, code_is_part_number) of a header row.

    The leftmost column of a field counts; further price columns that name a currency are kept as
    conversions. The price column's own header tells the currency; without one, and without
    conversions, the first currency in the header does.
    """
    read = F.transform(cells, lambda c, i: F.struct(i.alias("at"), header_field(c).alias("field"), header_currency(c).alias("currency"), header_text(c).alias("text")))

    def made(all_: Column) -> Column:
        named = F.filter(all_, lambda x: x["field"].isNotNull())
        fields = F.transform(named, lambda x: x["field"])
        first = F.filter(named, lambda x, i: F.array_position(fields, x["field"]) == i + 1)
        prices = F.filter(named, lambda x: x["field"] == "price")
        own = F.get(prices, F.lit(0))["currency"]
        later = F.filter(F.slice(prices, F.lit(2), F.greatest(F.size(prices), F.lit(1))), lambda x: x["currency"].isNotNull())
        codes = F.transform(later, lambda x: x["currency"])
        others = F.filter(later, lambda x, i: F.array_position(codes, x["currency"]) == i + 1)
        any_ = F.get(F.filter(all_, lambda x: x["currency"].isNotNull()), F.lit(0))["currency"]
        code = F.get(F.filter(first, lambda x: x["field"] == "code"), F.lit(0))
        return F.struct(
            F.map_from_entries(F.transform(first, lambda x: F.struct(x["field"], x["at"]))).alias("fields"), F.map_from_entries(F.transform(others, lambda x: F.struct(x["currency"], x["at"]))).alias("other_prices"),
            F.coalesce(own, F.when(F.size(others) == 0, any_)).alias("currency"), F.coalesce(~code["text"].isin(OWN_CODES), F.lit(False)).alias("code_is_part_number"),
        )

    return F.transform(F.array(read), made)[0]


def availability(text: Column) -> Column:
    """struct(availability, note): incoming and when, for a title or heading that says so; nulls for others."""
    flat = F.replace(text, F.lit("_"), F.lit(" "))
    eta = F.regexp_replace(F.nullif(F.regexp_extract(flat, ETA, 1), F.lit("")), r"^[ \-:.]+|[ \-:.]+$", "")
    comes = F.coalesce(flat.rlike(INCOMING), F.lit(False))
    return F.struct(F.when(comes, "incoming").alias("availability"), F.when(comes & eta.isNotNull(), F.concat(F.lit("ETA "), eta)).alias("note"))


def _profiles(heads: DataFrame, grid: DataFrame) -> DataFrame:
    """(GRID, head, columns): for each head the columns of the SAMPLE rows below: at, n, wordy and priceable (shares of filled cells), and how many rows have any."""
    below = heads.select(*GRID, "head").join(grid, GRID).where((F.col("row_idx") > F.col("head")) & (F.col("row_idx") <= F.col("head") + SAMPLE))
    cells = below.select(*GRID, "head", "row_idx", F.posexplode("cells").alias("at", "cell")).withColumn("cell", F.trim("cell")).where("cell <> ''")
    text = F.col("cell")
    share = lambda test: F.count_if(F.coalesce(test, F.lit(False))) / F.count("*")
    each = cells.groupBy(*GRID, "head", "at").agg(F.count("*").alias("n"), share(n.is_wordy(text)).alias("wordy"), share(n.parse_price(text).isNotNull() & (F.length(text) < 16)).alias("priceable"))
    filled = below.where(F.exists("cells", lambda c: F.trim(c) != "")).groupBy(*GRID, "head").agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("width"))
    return each.groupBy(*GRID, "head").agg(F.array_sort(F.collect_list(F.struct("at", "n", "wordy", "priceable"))).alias("columns")).join(filled, [*GRID, "head"])


def _wordiest(taken: Column) -> Column:
    """The column, not among those taken, of which most filled cells read as a product's name; the leftmost of equals."""
    fit = F.filter("columns", lambda x: (x["n"] >= 2) & (x["wordy"] >= WORDY) & ~F.array_contains(taken, x["at"]))
    most = F.array_max(F.transform(fit, lambda x: x["wordy"]))
    return F.get(F.filter(fit, lambda x: x["wordy"] == most), F.lit(0))["at"]


def headers(named: DataFrame) -> DataFrame:
    """(GRID, head, fields, other_prices, header_currency, code_is_part_number) of each grid that can be read; head is -1 without a header.

    The header is the row among the first HEAD_ROWS that names the most distinct fields, at least
    HEAD_FIELDS; the earliest of equals. Else it is the first row of PARTIAL_ROWS that names a price or a quantity above a
    column of products. A blank or wrong heading of the product column is mended from the cells below. Else a table
    of two or three columns is read from its cells alone: one of words, another of prices.
    """
    best = F.row_number().over(Window.partitionBy(*GRID).orderBy(F.desc("distinct"), "row_idx"))
    mapped = lambda rows: rows.withColumn("map", mapped_columns(F.col("cells"))).select(*GRID, F.col("row_idx").alias("head"), "map.fields", "map.other_prices", F.col("map.currency").alias("header_currency"), "map.code_is_part_number")
    full = mapped(named.where((F.col("row_idx") < HEAD_ROWS) & (F.size("cells") > 0)).withColumn("place", best).where((F.col("place") == 1) & (F.col("distinct") >= HEAD_FIELDS)))
    read = named.where(F.col("row_idx") < HEAD_ROWS).groupBy(*GRID).agg(F.max("distinct").alias("most")).where(F.col("most") >= HEAD_FIELDS).select(*GRID)
    rest = named.join(read, GRID, "left_anti")
    one = rest.where((F.col("row_idx") < PARTIAL_ROWS) & (F.array_contains("named", "price") | F.array_contains("named", "quantity")) & ~F.array_contains(F.array_compact("named"), "description"))
    heads = stored(full.withColumn("partial", F.lit(False)).unionByName(mapped(one).withColumn("partial", F.lit(True))), "heads")
    seen = heads.join(_profiles(heads, named), [*GRID, "head"], "left")
    own = F.element_at("fields", F.lit("description"))
    column = F.get(F.filter("columns", lambda x: x["at"] == own), F.lit(0))
    codes = own.isNotNull() & (column["n"] >= 3) & (column["wordy"] < 0.5)
    found = _wordiest(F.map_values("fields"))
    product = F.when(own.isNull() | F.coalesce(codes, F.lit(False)), F.coalesce(found, own)).otherwise(own)
    others = F.map_filter("fields", lambda k, v: k != "description")
    seen = seen.withColumn("fields", F.when(product.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit("description"), product))))
    usable = F.map_contains_key("fields", "description") & (F.map_contains_key("fields", "price") | F.map_contains_key("fields", "quantity"))
    first = F.row_number().over(Window.partitionBy(*GRID).orderBy("head"))
    seen = stored(seen.where(usable | ~F.col("partial")).withColumn("place", first).where("place = 1").select(*heads.columns).drop("partial"), "headers")
    bare = rest.join(seen.select(*GRID), GRID, "left_anti")
    shape = _profiles(bare.select(*GRID).distinct().withColumn("head", F.lit(-1)), bare).where("rows >= 4 and width between 2 and 3")
    words = F.get(F.filter("columns", lambda x: (x["n"] >= 3) & (x["wordy"] >= WORDY)), F.lit(0))["at"]
    shape = shape.withColumn("words", words)
    prices = F.get(F.filter("columns", lambda x: (x["n"] >= 3) & (x["priceable"] >= WORDY) & (x["at"] != F.col("words"))), F.lit(0))["at"]
    shape = shape.withColumn("prices", prices).where("words is not null and prices is not null")
    fields = F.map_from_arrays(F.array(F.lit("description"), F.lit("price")), F.array("words", "prices"))
    none = F.create_map().cast("map<string,int>")
    return seen.unionByName(shape.select(*GRID, "head", fields.alias("fields"), none.alias("other_prices"), F.lit(None).cast("string").alias("header_currency"), F.lit(False).alias("code_is_part_number")))


def with_header(grid: DataFrame) -> DataFrame:
    """The rows below the header, with ``fields`` (field to column, the leftmost for each), other_prices,
    header_currency and code_is_part_number, as ``headers`` reads them. Grids that cannot be read give no rows; reprinted headers go.
    """
    # cells are dear to read, and few long lists would be few tasks
    named = stored(spread(grid, *GRID, "row_idx").withColumn("named", F.transform("cells", header_field)), "named").withColumn("distinct", F.size(F.array_compact(F.array_distinct("named"))))
    return named.join(headers(named), GRID).where((F.col("row_idx") > F.col("head")) & (F.col("distinct") < AGAIN_FIELDS)).drop("named", "distinct", "head")


def with_section(rows: DataFrame) -> DataFrame:
    """``section``: the last heading above; headings (one short cell that is no number) are no rows.

    ``incoming``: availability and note, from the title of the grid until a heading speaks of stock
    on its way (it sets them) or on hand (it clears them).
    """
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    text = F.get(filled, F.lit(0))
    heading = F.when((F.size(filled) == 1) & (F.length(text) <= 40) & ~text.rlike(NOT_PRODUCT) & ~text.rlike(r"^[\d\s.,€$£]+$"), text)
    above = F.last("__heading", ignorenulls=True).over(Window.partitionBy(*GRID).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0))
    said = F.when(F.col("__heading").rlike(INCOMING), availability(F.col("__heading"))).when(F.col("__heading").rlike(IN_STOCK), availability(F.lit("")))
    last = F.last("__said", ignorenulls=True).over(Window.partitionBy(*GRID).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__heading", heading).withColumn("section", above).withColumn("__said", said).withColumn("incoming", F.coalesce(last, availability(F.col("source"))))
    return rows.where("__heading is null").drop("__heading", "__said")


def extract_rows(grid: DataFrame) -> DataFrame:
    """One row for each line of a list: what it describes, codes, quantity, price, section and where it stood.

    A line needs a description that is a product, and a price or a quantity.
    """
    rows = spread(with_section(with_header(grid)), *GRID, "row_idx")
    cell = lambda f: F.nullif(F.trim(F.get(F.col("cells"), F.element_at("fields", F.lit(f)))), F.lit(""))
    out = rows.select(
        *GRID, "row_idx", cell("description").alias("description"), n.ean(cell("ean")).alias("ean"), n.quantity(cell("quantity")).alias("quantity"), n.parse_price(cell("price")).alias("price"),
        F.coalesce(n.currency(cell("currency")), "header_currency", n.currency(cell("price"))).alias("currency"), cell("brand").alias("brand"), cell("grade").alias("grade"), cell("colour").alias("colour"), cell("capacity").alias("capacity"), cell("ram").alias("ram"), cell("region").alias("region"),
        F.when(F.col("code_is_part_number"), cell("code")).alias("part_number"), "section", "incoming.availability", F.col("incoming.note").alias("availability_note"),
        F.concat("source", F.lit(" row "), (F.col("row_idx") + 1).cast("string")).alias("source_ref"),
    )
    product = F.col("description").isNotNull() & ~F.col("description").rlike(NOT_PRODUCT) & ~F.col("description").rlike(r"^\d+$")
    return out.where(product & (F.col("price").isNotNull() | F.col("quantity").isNotNull()))
