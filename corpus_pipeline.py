"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``. In every stage null and empty texts and null ids stay, texts of any length count whole,
rows that repeat id and text have one fate, an empty table gives an empty one, and further columns
pass through, whatever their names; the last one has the columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotloom.llm import line_dedup, minhash_dedup, mixing, packing, scratch, tokens, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    with scratch.stage():
        scratch.small_batches(spark)
        return toxicity.without_toxic(docs, toxicity.learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; a document of which every line was one goes, others keep the rest."""
    lines, deleted = scratch.fresh(docs, "lines"), scratch.fresh(docs, "deleted")
    with scratch.stage():
        left = line_dedup.without_copies(docs, counts=(lines, deleted))
    changed = F.col(deleted) > 0
    left = left.where(~changed | (F.col(deleted) < F.col(lines)))
    return left.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    with scratch.stage():
        return minhash_dedup.without_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as the target shares of domains want it; none goes."""
    with scratch.stage():
        return mixing.repeated(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with the sequence and offset they go to."""
    with scratch.stage():
        return packing.packed(docs, tokens.vocabulary(packing.VOCABULARY))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", near_dedup),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the learnt stages nor the tokenizer; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
