"""Names, colours, grades, markets and quoted history, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalise import MARKED

# Legal forms, and words that tell no company from another.
LEGAL = ["ab", "ag", "aps", "as", "bv", "co", "corp", "doo", "eood", "gmbh", "inc", "kft", "kg", "llc", "ltd", "limited", "nv", "ood", "ou", "oy", "plc", "sa", "sarl", "sas", "sl", "spa", "spzoo", "sro", "srl", "sp", "zoo", "ug"]
GENERIC = ["team", "sales", "info", "offer", "offers", "request", "stock", "list", "trading", "trade", "export", "import", "group", "international", "telecom", "electronics", "mobile", "mobiles", "phone", "phones", "gsm", "distribution", "company", "the", "and", "new", "all", "best", "global", "world", "tech"]
# Colours written another way.
COLOURS = {
    "space grey": "Space Gray", "space gray": "Space Gray", "spc grey": "Space Gray", "spc gray": "Space Gray", "sg": "Space Gray", "grey": "Gray", "gray": "Gray",
    "nat titanium": "Natural Titanium", "natural ti": "Natural Titanium", "nat ti": "Natural Titanium", "blue ti": "Blue Titanium", "black ti": "Black Titanium",
    "white ti": "White Titanium", "desert ti": "Desert Titanium", "midnite": "Midnight", "star light": "Starlight", "prod red": "Product Red", "product (red)": "Product Red",
    "red": "Red", "rose gold": "Rose Gold", "sierra blue": "Sierra Blue", "pacific blue": "Pacific Blue", "deep purple": "Deep Purple", "alpine green": "Alpine Green",
}
# The market that a code is built for.
FAMILY = {
    "LL/A": "US", "US": "US", "ZP/A": "ME", "CH/A": "CN", "J/A": "JP", "X/A": "AU", "B/A": "UK", "UK": "UK", "F/A": "EU", "D/A": "EU", "T/A": "EU", "Y/A": "EU",
    "ZD/A": "EU", "QN/A": "EU", "EU": "EU", "ZA/A": "SG", "IP/A": "INDIA", "HN/A": "INDIA", "HX/A": "INDIA", "INDIA": "INDIA", "KH/A": "KR", "TA/A": "TW", "AA/A": "CA",
    "VC/A": "CA", "RS/A": "RU", "BR/A": "BR", "NON-EU": "NON-EU", "GLOBAL": "GLOBAL",
}
# Fixed patterns: where a quoted reply begins, and a message that is forwarded.
REPLIES = [
    r"(?im)^\s*(?:On|Am|Le|Il|El)\b[^\n]{0,160}\b(?:wrote|schrieb|a écrit|ha scritto):\s*$",
    r"(?im)^\s*-{2,}\s*Original Message\s*-{2,}",
    r"(?m)^\s*_{10,}\s*$",
    r"(?m)^>[^\n]*\n>[^\n]*\n>",
]
FORWARD = r"(?im)-{2,}\s*Forwarded message\s*-{2,}|Begin forwarded message|^\s*(?:Weitergeleitete Nachricht|Messaggio inoltrato|Mensaje reenviado)"


def company_tokens(name: Column) -> Column:
    """Words of a company name without marks, single characters and legal forms."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]+", " "), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(LEGAL))


def is_distinctive(name: Column) -> Column:
    """A word of three characters or more that half the trade does not use."""
    return F.exists(company_tokens(name), lambda w: (F.length(w) >= 3) & ~w.isin(GENERIC))


def company_matches(subject: Column, stored: Column) -> Column:
    """Every word of a distinctive name stands in the stored one."""
    return is_distinctive(subject) & (F.size(F.array_except(company_tokens(subject), company_tokens(stored))) == 0)


def colour(text: Column) -> Column:
    """The usual spelling of a colour; null for empty text only."""
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[®™()\[\],\-_/]", " "), r"\s+", " ")))
    names = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    words = F.split(key, " ")
    capital = lambda ws: F.array_join(F.transform(ws, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))), " ")
    rest = F.filter(words, lambda w: w != "titanium")
    titanium = (key.endswith(" titanium") | key.startswith("titanium ")) & (F.size(rest) > 0)
    plain = F.regexp_replace(capital(words), r"\bGrey\b", "Gray")
    return F.when(key != "", F.coalesce(F.try_element_at(names, key), F.when(titanium, F.concat(capital(rest), F.lit(" Titanium"))), plain))


# Fixed pattern: words beside a grade that do not change it.
FILLER = r"\b(?:grade|graded|cond|condition|quality|class|stock|units?|phones?)\b"


def grade_key(text: Column) -> Column:
    """A written grade without marks, filler and doubled blanks, in lower case; null if nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(text), r"[()\[\].,:;\"']", " "), FILLER, " ")
    key = F.regexp_replace(F.regexp_replace(key, r"[-_]", " "), r"\s*\+\s*", "+")
    return F.nullif(F.trim(F.regexp_replace(key, r"\s+", " ")), F.lit(""))


def grade(text: Column, aliases: Column | None = None) -> Column:
    """A to E with a plus, or what the sender's map of aliases makes of it, else null."""
    key = grade_key(text)
    known = F.lit(None).cast("string") if aliases is None else F.try_element_at(aliases, key)
    return F.coalesce(known, F.when(key.rlike(r"^[a-e][+\-]?$"), F.upper(key)))


def regions_conflict(a: Column, b: Column) -> Column:
    """Two stated markets that differ; outside the EU conflicts with the EU alone. A code that no family
    has is a market of its own."""
    names = F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair])
    x, y = (F.coalesce(F.try_element_at(names, F.upper(c)), F.nullif(F.upper(c), F.lit(""))) for c in (a, b))
    outside = (x == "NON-EU") | (y == "NON-EU")
    return F.coalesce(F.when(outside, (x == "EU") | (y == "EU")).otherwise(x != y), F.lit(False))


def price_lines(text: Column) -> Column:
    """Lines in which something is marked as money."""
    return F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(MARKED)))


def without_quoted_history(body: Column) -> Column:
    """The message without the reply it quotes; whole if a forwarded message or most prices are below."""
    starts = [F.when(body.rlike(p), F.length(F.element_at(F.split(body, p, 2), 1)) + 1) for p in REPLIES]
    cut = F.least(*starts)
    kept, dropped = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut, F.length(body))
    whole = cut.isNull() | dropped.rlike(FORWARD) | (price_lines(dropped) > price_lines(kept))
    return F.when(whole, body).otherwise(F.regexp_replace(kept, r"\s+$", ""))


# Fixed patterns, in order: what names a brand.
BRANDS = [
    (r"\b(?:iphone|ipad|airpods?|airtag|macbook|imac|apple\s*watch|magsafe|apple)\b", "Apple"),
    (r"(?<!galaxy )(?<!huawei )(?<!honor )\bwatch\s*(?:ultra|series|se)\b", "Apple"),
    (r"\b(?:beats|powerbeats|solo\s*buds|studio\s*buds)\b", "Apple"),
    (r"\b(?:sandisk|cruzer|extreme\s*pro)\b|\bultra\b[^\n]{0,28}\bflash\s*drive\b|\b(?:ultra|extreme)\s*(?:flair|fit|dual|shift|luxe|go)\b", "SanDisk"),
    (r"\bSM[\s-]?[A-Z]\d{3}", "Samsung"), (r"\b(?:samsung|galaxy)\b", "Samsung"), (r"\b(?:google\s*pixel|pixel|google)\b", "Google"),
    (r"\b(?:xiaomi|redmi|poco|mi\s*band)\b", "Xiaomi"), (r"(?:\bmotorola\b|\bmot\.|\bmoto\s*[ge]\b|\bmoto\b|\brazr\b)", "Motorola"), (r"\bninja\b", "Ninja"),
    (r"\b(?:nothing\s*(?:phone|watch|ear)|nothing)\b", "Nothing"), (r"\b(?:dyson|airwrap|supersonic)\b", "Dyson"), (r"\bgopro\b", "GoPro"), (r"\b(?:dji|osmo|mavic|ronin)\b", "DJI"),
    (r"\bmarshall\b", "Marshall"), (r"\b(?:amazon|echo\s*(?:dot|spot|show)|fire\s*(?:hd|tv)|kindle|alexa)\b", "Amazon"), (r"\bdreame\b", "Dreame"), (r"\bcat\s*s\d{2}\b", "CAT"),
    (r"\b(?:bosch|philips|braun)\b", "Other"), (r"\b(?:oneplus|one\s*plus)\b", "OnePlus"), (r"\b(?:playstation|ps5|ps4|sony|bravia|xperia)\b|\b(?:WH|WF)-[A-Z0-9]{4,}|\bXQ-[A-Z]{2}\d{2}", "Sony"),
    (r"\b(?:nintendo|switch\s*2|switch)\b", "Nintendo"), (r"\bhonor\b", "Honor"), (r"\bhuawei\b", "Huawei"), (r"\boppo\b", "Oppo"), (r"\bvivo\b", "Vivo"), (r"\brealme\b", "Realme"),
    (r"\bnokia\b", "Nokia"), (r"\b(?:microsoft|xbox|surface)\b", "Microsoft"), (r"\b(?:lenovo|thinkpad)\b", "Lenovo"), (r"\basus\b", "Asus"), (r"\bacer\b", "Acer"),
    (r"\b(?:hewlett|hp)\b", "HP"), (r"\bdell\b", "Dell"), (r"\btcl\b", "TCL"), (r"\blg\b", "LG"), (r"\bjbl\b", "JBL"), (r"\banker\b", "Anker"), (r"\bbelkin\b", "Belkin"),
    (r"\b4smarts\b", "4smarts"), (r"\bamazfit\b", "Amazfit"), (r"\bgarmin\b", "Garmin"),
]
SAMSUNG_CODE = r"\b[ASFGZN]\d{3}[A-Z]?\b"
SAMSUNG_CONTEXT = r"(?i)\b(?:5g|lte|ds|duos|ent\.?\s*ed\.?)\b|\b\d{1,2}\s*\+\s*\d{2,4}\b"


def brand(text: Column) -> Column:
    """The first brand of the list that the text names; else Samsung by a part code in its usual company."""
    named = [F.when(text.rlike(f"(?i){pattern}"), F.lit(name)) for pattern, name in BRANDS]
    return F.coalesce(*named, F.when(text.rlike(SAMSUNG_CODE) & text.rlike(SAMSUNG_CONTEXT), F.lit("Samsung")))
