"""Descriptions of logs, sessions, items and embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewright.functions.vectors import norm
from slatewright.operators.blocks import (cosine_moments, nearest, ordered_pair_quantiles,
                                          similarity_quantiles)
from slatewright.operators.ranking import rank_overall

PERCENTILES = tuple(i / 20 for i in range(21))


def log_summary(log: DataFrame) -> DataFrame:
    """One row: items, sessions, interactions and mean session length.

    Distinct counts come from two grouped passes instead of one expanded pass.
    """
    items = log.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    sessions = log.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return sessions.agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_interactions"),
        (F.sum("n") / F.count(F.lit(1))).alias("mean_length")).withColumn("n_items", items)


def rows_per(log: DataFrame, column: str) -> DataFrame:
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def item_frequency(log: DataFrame) -> DataFrame:
    """``item_id, share``: interactions with the item over all interactions."""
    total = log.agg(F.count(F.lit(1))).scalar()
    return rows_per(log, "item_id").select("item_id", (F.col("n") / total).alias("share"))


def summary_of(sizes: DataFrame, column: str = "n",
               quantiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """``statistic, value``: count, mean, deviation, extremes and exact percentiles.

    Values are counted first, so the percentile state holds distinct values only.
    """
    counted = sizes.groupBy(column).agg(F.count(F.lit(1)).alias("f"))
    value, weight = F.col(column).cast("double"), F.col("f")
    n = F.sum(weight)
    mean = F.sum(value * weight) / n
    variance = (F.sum(value * value * weight) - n * mean * mean) / (n - 1)
    percentiles = F.percentile(value, F.array(*[F.lit(float(q)) for q in quantiles]), weight)
    one = counted.agg(n.cast("double").alias("count"), mean.alias("mean"),
                      F.sqrt(variance).alias("std"), F.min(value).alias("min"),
                      F.max(value).alias("max"), percentiles.alias("p"))
    entries = [F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value"))
               for c in ("count", "mean", "std", "min", "max")]
    entries += [F.struct(F.lit(f"{100 * q:g}%").alias("statistic"), F.col("p")[i].alias("value"))
                for i, q in enumerate(quantiles)]
    return one.select(F.inline(F.array(*entries)))


def session_length_summary(log: DataFrame) -> DataFrame:
    return summary_of(rows_per(log, "session_id"))


def length_percentile(log: DataFrame, q: float) -> DataFrame:
    """One row ``length``: session length at the percentile (a sequence length to use)."""
    counted = rows_per(log, "session_id").groupBy("n").agg(F.count(F.lit(1)).alias("f"))
    return counted.agg(F.percentile("n", F.lit(float(q)), F.col("f")).alias("length"))


def length_histogram(log: DataFrame, longest: int) -> DataFrame:
    """``length, n_sessions``; sessions above ``longest`` share the last bucket."""
    bucket = F.least(F.col("n"), F.lit(longest + 1)).alias("length")
    return rows_per(log, "session_id").groupBy(bucket).agg(F.count(F.lit(1)).alias("n_sessions"))


def popularity_curve(log: DataFrame) -> DataFrame:
    """``place, item_id, n``: items by interaction count."""
    counts = rows_per(log, "item_id")
    return rank_overall(counts, [F.desc("n"), F.col("item_id")], name="place")


def norm_range(items: DataFrame) -> DataFrame:
    sizes = items.select(norm("embedding").alias("length"))
    return sizes.agg(F.min("length").alias("min_norm"), F.max("length").alias("max_norm"))


def pair_distance_summary(items: DataFrame) -> DataFrame:
    """``statistic, value`` of the cosine distance over all item pairs."""
    mean, std = cosine_moments(items)
    low, q25, q50, q75, high = similarity_quantiles(items, [0.0, 0.25, 0.5, 0.75, 1.0])
    rows = [("mean", 1 - mean), ("std", std), ("min", 1 - high), ("q25", 1 - q75),
            ("median", 1 - q50), ("q75", 1 - q25), ("max", 1 - low)]
    return items.sparkSession.createDataFrame(rows, "statistic string, value double")


def neighbour_distance_summary(items: DataFrame, k: int = 10) -> DataFrame:
    """Mean over items of mean, deviation, min and max distance to the k nearest others."""
    queries = items.select(F.col("item_id").alias("case_id"), F.col("embedding").alias("vector"),
                           F.array("item_id").alias("seen"))
    near = nearest(queries, items, k, "cosine", seen="seen", strict=True)
    distance = F.lit(1.0) - F.col("score")
    per_item = near.groupBy("case_id").agg(
        F.avg(distance).alias("mean"), F.stddev_pop(distance).alias("std"),
        F.min(distance).alias("min"), F.max(distance).alias("max"))
    return per_item.agg(*[F.avg(c).alias(c) for c in ("mean", "std", "min", "max")])


def similarity_cutoffs(items: DataFrame, quantiles: Sequence[float]) -> list[float]:
    """Quantiles of the similarity of different items, as cut-off values."""
    return ordered_pair_quantiles(items, quantiles)


def session_popularity(log: DataFrame) -> DataFrame:
    """``item_id, popularity``: share of sessions that hold the item."""
    total = log.select("session_id").distinct().agg(F.count(F.lit(1))).scalar()
    pairs = log.select("session_id", "item_id").distinct()
    return pairs.groupBy("item_id").agg((F.count(F.lit(1)) / total).alias("popularity"))


def popularity_cutoffs(popularity: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """``quantile, cutoff``: interpolated quantiles over items, from value counts."""
    counted = popularity.groupBy("popularity").agg(F.count(F.lit(1)).alias("f"))
    levels = F.array(*[F.lit(float(q)) for q in quantiles])
    one = counted.agg(F.percentile("popularity", levels, F.col("f")).alias("c"))
    return one.select(F.inline(F.arrays_zip(levels.alias("quantile"), F.col("c").alias("cutoff"))))


def rolling_mean(series: DataFrame, value: str, step: str = "step", window: int = 64,
                 keys: Sequence[str] = (), chunk: int = 4096) -> DataFrame:
    """Mean of the last ``window`` rows by dense ``step``; NULL before the window is full.

    The series is cut into chunks of steps; each chunk also gets the ``window - 1`` rows
    before it, so any number of tasks can work on one series.
    """
    label = F.floor(F.col(step) / chunk)
    ahead = F.floor((F.col(step) + window - 1) / chunk)
    halo = series.withColumn("_own", label).withColumn("_chunk", F.explode(F.sequence(label, ahead)))
    frame = Window.partitionBy(*keys, "_chunk").orderBy(step).rowsBetween(-(window - 1), 0)
    mean = F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))
    return (halo.withColumn("rolling", mean).where(F.col("_chunk") == F.col("_own"))
            .drop("_chunk", "_own"))
