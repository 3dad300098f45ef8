"""Model names the rules cannot settle: which pairs may be put to somebody, and at most four candidates for each.

Two names may be the same only if they differ in nothing but descriptive words, so what is left of both without
those words, the core, is equal, and it has a digit. New wordings meet the catalogue by one equi-join over brand and core.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v

#: Candidates of a question, and questions of a message, at most.
CANDIDATES, QUESTIONS = 4, 60


def descriptive(word: Column) -> Column:
    """A word of two letters or more, and nothing else, that does not tell one model from another."""
    return word.rlike(r"^\p{L}{2,}$") & ~word.isin(v.VARIANTS)


def _keyed(rows: DataFrame) -> DataFrame:
    words = F.array_distinct("model_tokens")
    core = F.array_sort(F.filter(words, lambda t: ~descriptive(t)))
    return rows.withColumns({"words": F.array_sort(words), "core": F.when(F.exists(core, lambda t: t.rlike(r"\d")), F.array_join(core, " ")), "brand_key": F.coalesce("model_brand", F.lit(""))})


def pending_questions(lines: DataFrame, catalogue: DataFrame, settled: DataFrame, message: str, order: str, most: int = QUESTIONS) -> DataFrame:
    """(message, model_key, wording, candidates) of lines whose model is close to others of the catalogue, and not settled.

    lines: rows of ``with_model`` with message, an order and text; catalogue: such rows with text and an order; settled: from_key of answers
    there are already, a no as well. The first line of a key asks, the first ``most`` keys of a message; candidates are
    structs of key and example, the four with the shortest keys.
    """
    first = lambda rows, by: rows.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(order, "text"))).where("turn = 1").drop("turn")
    done = settled.select(F.col("from_key").alias("model_key")).distinct()
    open_ = lambda rows: rows.where("model_key <> ''").join(done, "model_key", "left_anti")
    asks = _keyed(first(open_(lines), [message, "model_key"])).where("core is not null")
    known = _keyed(first(open_(catalogue), ["model_key"])).where("core is not null")
    # a line with a brand meets that brand and lines without one; a line without meets all
    left = asks.select(message, order, "model_key", F.col("text").alias("wording"), "core", "words", "model_category", F.explode(F.when(F.col("brand_key") == "", F.array(F.lit("*"))).otherwise(F.array("brand_key", F.lit("")))).alias("brand_key"))
    right = known.select(F.col("model_key").alias("key"), F.col("text").alias("example"), "core", F.col("words").alias("their_words"), F.col("model_category").alias("their_category"), F.explode(F.array("brand_key", F.lit("*"))).alias("brand_key"))
    met = left.join(right, ["core", "brand_key"]).where("model_key <> key and words <> their_words").where(F.coalesce(F.col("model_category") == F.col("their_category"), F.lit(True)))
    place = F.row_number().over(Window.partitionBy(message, "model_key").orderBy(F.length("key"), "key"))
    met = met.withColumn("place", place).where(F.col("place") <= CANDIDATES)
    found = met.groupBy(message, order, "model_key", "wording").agg(F.array_sort(F.collect_list(F.struct("place", "key", "example"))).alias("all"))
    turn = F.row_number().over(Window.partitionBy(message).orderBy(order, "model_key"))
    return found.withColumn("turn", turn).where(F.col("turn") <= most).select(message, "model_key", "wording", F.transform("all", lambda x: F.struct(x["key"].alias("key"), x["example"].alias("example"))).alias("candidates"))


def answered(questions: DataFrame, answers: DataFrame, message: str) -> DataFrame:
    """(from_key, to_key, source) of answers (message, model_key, choice: number of the candidate from 1, 0 for none of them); numbers
    that name no candidate and answers to other questions count for nothing. A no is a row without to_key."""
    rows = questions.join(answers, [message, "model_key"]).where((F.col("choice") >= 0) & (F.col("choice") <= F.size("candidates")))
    return rows.select(F.col("model_key").alias("from_key"), F.get("candidates", F.col("choice") - 1)["key"].alias("to_key"), F.lit("model").alias("source"))
