"""Popularity counts and the popularity recommender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item_counts(log: DataFrame) -> DataFrame:
    """``item_id, count``: interactions per item."""
    return log.groupBy("item_id").agg(F.count(F.lit(1)).alias("count"))


def popular_items(counts: DataFrame, k: int) -> DataFrame:
    """``rank, item_id, score``: the k most frequent items, ties by item id.

    Sort-and-limit keeps k rows per task; the window only sees those k rows.
    """
    best = counts.orderBy(F.desc("count"), "item_id").limit(k)
    order = Window.orderBy(F.desc("count"), "item_id")
    return best.select(F.row_number().over(order).alias("rank"), "item_id",
                       F.col("count").cast("double").alias("score"))


def popular_array(counts: DataFrame, k: int) -> Column:
    """The k most frequent items as one array value (a scalar subquery)."""
    best = counts.orderBy(F.desc("count"), "item_id").limit(k)
    packed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "item_id")))
    return best.agg(F.transform(packed, lambda x: x["item_id"]).alias("items")).scalar()


def recommend_popular(train: DataFrame, cases: DataFrame, k: int,
                      model: str = "popular") -> DataFrame:
    """``model, case_id, rank, item_id, score``: the same k items for every case.

    Fails when the log holds fewer than k items.
    """
    best = item_counts(train).orderBy(F.desc("count"), "item_id").limit(k)
    packed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "item_id")))
    slate = best.agg(packed.alias("slate")).scalar()
    short = F.raise_error(F.lit(f"fewer than {k} items to recommend"))
    slate = F.when(F.size(slate) < k, short).otherwise(slate)
    rows = cases.select("case_id", F.posexplode(slate).alias("at", "entry"))
    return rows.select(F.lit(model).alias("model"), "case_id",
                       (F.col("at") + 1).alias("rank"), F.col("entry.item_id").alias("item_id"),
                       (-F.col("entry.c")).cast("double").alias("score"))
