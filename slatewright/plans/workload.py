"""Canonical tables on top of the star-schema test data.

A customer's line items, in shipping order, are a session; a part is an item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewright.operators.ranking import rank_within
from slatewright.sources.tables import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, item_id, ts, reward`` plus the tie-break columns ``t1..t6``."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("session_id"), F.col("l_partkey").alias("item_id"),
        F.col("l_shipdate").alias("ts"), F.lit(1.0).alias("reward"),
        F.col("l_orderkey").alias("t1"), F.col("l_linenumber").alias("t2"),
        F.col("l_suppkey").alias("t4"), F.col("l_quantity").alias("t5"),
        F.col("l_extendedprice").alias("t6"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, item_id, ts, reward, pos`` with ``pos`` 1-based in session order.

    Ranking reads its input several times, so the join is stored first.
    """
    joined = stored(spark, sf_dir, "raw", lambda: raw_log(spark, sf_dir))
    order = [F.col(c) for c in ("ts", "t1", "t2", "item_id", "t4", "t5", "t6")]
    return rank_within(joined, ["session_id"], order).select(
        "session_id", "item_id", "ts", "reward", "pos")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, embedding array<double>, class`` from the embedding table."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("class"))


def on_vector_items(log: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with items folded onto the embedding table's id range."""
    n_vectors = table(spark, sf_dir, "embeddings").count()
    return log.withColumn("item_id", F.pmod("item_id", F.lit(n_vectors)))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, name`` with unique names."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.concat_ws(" #", "p_name", F.col("p_partkey").cast("string")).alias("name"))
