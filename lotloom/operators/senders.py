"""Who a message is from, step by step from the envelope to a company in the subject, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: an address, the start of a forwarded message, its header, and one without a marker.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
FORWARDED = r"(?i)(?:begin\s+forwarded\s+message|-{2,}\s*original\s+message|-{2,}\s*forwarded\s+message)"
FROM = r"(?i)From:\s*\"?([^\"<\n\r]*?)\"?\s*<?\s*([\w.+-]+@[\w-]+\.[\w.-]+)"
BLOCK = (
    r"(?im)^\s*From:\s*\"?([^\"<\n\r]*?)\"?\s*<?\s*([\w.+-]+@[\w-]+\.[\w.-]+)[^\n]*\n(?:[^\n]*\n){0,3}?\s*(?:Sent|Date|Gesendet|Datum|Envoyé|Enviado):[^\n]*\n"
    r"(?:[^\n]*\n){0,3}?\s*(?:To|Subject|An|Betreff|À|Objet|Para|Asunto):"
)
MACHINE = r"(?:no-?reply|do-?not-?reply|unsubscribe|bounce|mailer|postmaster)"
# Fixed pattern: a company in a subject, and words that make it none.
SUBJECT = r"(?i)^\s*(?:(?:fw|fwd|re)\s*:\s*)?(.+?)\s*[-–—]?\s*(?:offers?|requests?|wtb|wts|stock\s*(?:list|sheet)|price\s*list)\s*[\d./_\s-]*$"
NO_COMPANY = (
    r"(?i)\b(?:today'?s?|daily|weekly|special|hot|best|our|my|the|stock|price|list|sheet|wts|wtb|fw|fwd|re|arrivals?|deals?|items?|products?|models?|"
    r"apple|samsung|xiaomi|google|huawei|motorola|oneplus|oppo|sony|nintendo|iphone|ipad|galaxy|pixel|watch|airpods|macbook|redmi|tab|accessor(?:y|ies)|"
    r"phones?|tablets?|laptops?|consoles?|update|offer|request)\b"
)
# Free mailboxes are people and no companies.
FREEMAIL = [
    "gmail.com", "googlemail.com", "hotmail.com", "outlook.com", "live.com", "yahoo.com", "yahoo.co.uk", "icloud.com", "me.com", "aol.com", "gmx.de", "web.de",
    "proton.me", "protonmail.com", "mail.ru", "yandex.ru",
]


def _blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def is_internal(email: Column, domains: list[str], addresses: list[str]) -> Column:
    """An address of the house: listed, or at one of its domains."""
    domain = F.element_at(F.split(email, "@"), -1)
    return F.lower(email).isin([a.lower() for a in addresses]) | F.lower(domain).isin([d.lower().lstrip("@") for d in domains])


def company_in_subject(subject: Column) -> Column:
    """The name before offer, request or list in a subject; null for names without a letter or of fewer than three characters."""
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(subject, r"\s+", " ")), r"(?i)^(?:fw|fwd|re)\s*:\s*", ""))
    name = F.regexp_replace(F.regexp_extract(clean, SUBJECT, 1), r"^[ \-–—]+|[ \-–—]+$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"[\d./_-]{6,}$", ""), r"^[ \-–—]+|[ \-–—]+$", "")
    return F.when(clean.rlike(SUBJECT) & (F.length(name) >= 3) & name.rlike("(?i)[a-z]"), name)


def resolved(sender: Column, subject: Column, body: Column, domains: list[str], addresses: list[str]) -> Column:
    """struct(email, name, method, confidence, needs_review): the first source that gives an outside party.

    domains and addresses: those of the house. Sources: the envelope, the header of a forwarded
    message, an address in the body that is nobody's free mailbox and no machine, a company in the
    subject.
    """
    def said(email: Column, name: Column, method: str, confidence: float, review: bool) -> Column:
        return F.struct(email.alias("email"), name.alias("name"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(review).alias("needs_review"))

    none, text = F.lit(None).cast("string"), F.coalesce(body, F.lit(""))
    outside = lambda e: F.coalesce(~is_internal(e, domains, addresses), F.lit(False))
    envelope = F.lower(F.nullif(F.regexp_extract(sender, EMAIL, 0), F.lit("")))
    shown = F.when(F.contains(sender, F.lit("<")), F.regexp_replace(F.trim(F.substring_index(sender, "<", 1)), r'^"+|"+$', ""))
    marked = text.rlike(FORWARDED)
    window, head = F.substring(F.element_at(F.split(text, FORWARDED, 2), -1), 1, 800), F.substring(text, 1, 6000)
    part = lambda k: F.when(marked, F.regexp_extract(window, FROM, k)).otherwise(F.regexp_extract(head, BLOCK, k))
    forwarded = F.nullif(F.lower(part(2)), F.lit(""))
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda e: F.lower(e)), lambda e: outside(e) & ~F.element_at(F.split(e, "@"), -1).isin(FREEMAIL) & ~e.rlike(MACHINE))
    signed, company = F.get(found, F.lit(0)), company_in_subject(subject)
    return (
        F.when(outside(envelope), said(envelope, _blank(shown), "envelope", 1.0, False)).when(outside(forwarded), said(forwarded, _blank(part(1)), "forwarded_header", 0.9, False))
        .when(signed.isNotNull(), said(signed, none, "body_signature", 0.5, True)).when(company.isNotNull(), said(none, company, "subject_company", 0.3, True)).otherwise(said(none, none, "unresolved", 0.0, True))
    )


def plausible_company(name: Column) -> Column:
    """A name that a counterparty may be opened under: short, without digits, and no word of goods or greetings."""
    text = F.trim(name)
    return F.coalesce(F.length(text).between(3, 40) & ~text.rlike(r"\d") & (F.size(F.split(text, r"\s+")) <= 4) & ~text.rlike(NO_COMPANY), F.lit(False))


def placeholder_address(name: Column) -> Column:
    """An address that nobody can have, for a supplier known by name only."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(slug, F.lit("")), F.lit("supplier")), F.lit("@no-address.invalid"))
