"""Who sent it, and whether it is trade: company names matched uniquely, the source gate, message ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wording import company_tokens, is_distinctive

# Fixed patterns of the gate: trade wording of a subject, money and product words of a body.
TRADE = r"(?i)\b(?:wts|wtb|wtt|rfq|offer|offers|stock|stocklist|price|pricelist|prices|list|quote|quotation|available|availability|angebot|lager|oferta|disponibil)\b"
MONEY_TOKEN = r"(?i)(?:[€$£]\s?\d|\b\d+[.,]?\d*\s?(?:eur|usd|gbp|€|\$|£))"
PRODUCT_TOKEN = r"(?i)\b(?:iphone|samsung|galaxy|xiaomi|redmi|pixel|oppo|vivo|realme|honor|motorola|nokia|ipad|macbook|airpods|gb|tb)\b"


def company_of(subjects: DataFrame, companies: DataFrame) -> DataFrame:
    """(subject columns, company_id) where a subject's name can only be one company; id null otherwise.

    subjects: subject_id, name; companies: company_id, name. Every word of the subject's name must
    stand in the company's. Candidates meet on the subject's rarest word, not on common ones.
    """
    have = companies.select("company_id", company_tokens(F.col("name")).alias("have"))
    words = have.select("company_id", "have", F.explode(F.array_distinct("have")).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("often"))
    asked = subjects.where(is_distinctive(F.col("name"))).select("subject_id", company_tokens(F.col("name")).alias("want"))
    rarest = asked.select("subject_id", "want", F.explode("want").alias("word")).join(often, "word", "left").groupBy("subject_id").agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)), "word")).alias("word"), F.first("want").alias("want"))
    met = rarest.join(words, "word").where(F.size(F.array_except("want", "have")) == 0)
    one = met.groupBy("subject_id").agg(F.min("company_id").alias("company_id"), F.count_distinct("company_id").alias("n")).where("n = 1").drop("n")
    return subjects.join(one, "subject_id", "left")


def kept_by_gate(subject: Column, body: Column, has_workbook: Column) -> Column:
    """A workbook, trade wording in the subject, or money and a product in the body."""
    text = F.coalesce(body, F.lit(""))
    return F.coalesce(has_workbook, F.lit(False)) | F.coalesce(subject, F.lit("")).rlike(TRADE) | (text.rlike(MONEY_TOKEN) & text.rlike(PRODUCT_TOKEN))


def gate_reason(subject: Column, body: Column, has_workbook: Column) -> Column:
    """Why a message is kept: attachment, subject or body; null for one that is dropped."""
    text = F.coalesce(body, F.lit(""))
    return (
        F.when(F.coalesce(has_workbook, F.lit(False)), "attachment").when(F.coalesce(subject, F.lit("")).rlike(TRADE), "subject")
        .when(text.rlike(MONEY_TOKEN) & text.rlike(PRODUCT_TOKEN), "body")
    )


def message_id(sender: Column, subject: Column, at: Column, body: Column) -> Column:
    """An id for a message without one, the same for two deliveries of it."""
    parts = [F.coalesce(sender, F.lit("")), F.lower(F.trim(F.coalesce(subject, F.lit("")))), F.unix_millis(at).cast("string"), F.length(F.trim(F.coalesce(body, F.lit("")))).cast("string")]
    return F.sha2(F.concat_ws("|", *parts), 256)
