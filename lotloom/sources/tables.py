"""The driver tables bound to lots (supply), requirements (demand) and lists.

Money is whole cents throughout, so sums and comparisons agree everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *key: str | Column) -> DataFrame:
    """Rows over as many tasks as a shuffle has, for work that is dear by the row: a small file is one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


#: Lines of a task that works out lots: its memory goes by them and not by the table.
LINES_A_TASK = 1_000_000
#: Suppliers that go to every task where lots lie by part, some 30 MB; more of them meet the lots in a shuffle.
SMALL_SUPPLIERS = 500_000


def tasks_for(lines: DataFrame) -> int:
    """As many tasks as have LINES_A_TASK of a table's lines each, and no fewer than a shuffle has."""
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_A_TASK))


def cents(amount: Column) -> Column:
    """Whole cents of an amount, halves up."""
    return F.floor(amount * 100 + F.lit(0.5)).cast("bigint")


def lots(spark: SparkSession, sf_dir: str, by_part: bool = False) -> DataFrame:
    """One lot for each supplier and part: supplier, country, part, quantity, price_cents, and what it is.

    by_part: lines move once, by their part, and a part's lots stay together; what meets them by part moves none of them.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    tasks = tasks_for(lines)
    if by_part:
        lines = lines.repartition(tasks, "l_partkey")
    elif tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(tasks, "l_suppkey", "l_partkey")
    sold = lines.groupBy("l_suppkey", "l_partkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
        F.sum(cents(F.col("l_extendedprice"))).alias("total"),
        F.max("l_shipdate").alias("seen_at"),
        F.min("l_returnflag").alias("grade"),
    )
    who = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    part = table(spark, sf_dir, "part")
    if by_part and table(spark, sf_dir, "supplier").count() <= SMALL_SUPPLIERS:
        who = F.broadcast(who.select("s_suppkey", "s_name", "n_name"))
    rows = sold.join(part.hint("merge") if by_part else part, F.col("l_partkey") == F.col("p_partkey")).join(who, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("l_suppkey").alias("supplier"), F.col("s_name").alias("supplier_name"), F.col("n_name").alias("country"), F.col("l_partkey").alias("part"),
        "quantity", F.expr("total div quantity").alias("price_cents"), "seen_at", "grade",
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_name").alias("description"), F.col("p_size").alias("capacity_gb"),
    )


def requirements(spark: SparkSession, sf_dir: str, by_part: bool = False) -> DataFrame:
    """One requirement for each customer and part: three times what was ordered, at the list price. by_part: as in ``lots``."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("q"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ordered = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    if by_part:
        ordered = ordered.select("o_custkey", "o_orderdate", "l_partkey", "q").repartition(tasks_for(lines), "l_partkey")
    wanted = ordered.groupBy("o_custkey", "l_partkey").agg((F.sum("q") * 3).alias("wanted"), F.max("o_orderdate").alias("asked_at"))
    part = table(spark, sf_dir, "part")
    return wanted.join(part.hint("merge") if by_part else part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_custkey").alias("buyer"), F.col("l_partkey").alias("part"), "wanted", cents(F.col("p_retailprice")).alias("limit_cents"), "asked_at",
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_name").alias("description"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two lists of each supplier, by the parity of the shipping year: (existing, incoming)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("q"), cents(F.col("l_extendedprice")).alias("c"), (F.year("l_shipdate") % 2).alias("odd"))
    one = rows.groupBy("supplier", "part", "odd").agg(F.sum("q").alias("quantity"), F.expr("sum(c) div sum(q)").alias("price_cents"))
    return tuple(one.where(F.col("odd") == k).drop("odd") for k in (0, 1))
