"""Item clusters and their popular members."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.operators.blocks import nearest
from slatewright.operators.ranking import top_n


def cluster_items(items: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(``item_id, cluster``, ``cluster, centre``) of k-means."""
    vectors = items.select("item_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    centres = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    table = items.sparkSession.createDataFrame(centres, "cluster long, centre array<double>")
    return model.transform(vectors).select("item_id", F.col("cluster").cast("long")), table


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def popular_per_cluster(assigned: DataFrame, counts: DataFrame, names: DataFrame) -> DataFrame:
    """``cluster, item_id, count``: the most frequent named item of each cluster."""
    named = assigned.join(names.where(F.col("name").isNotNull()).select("item_id"), "item_id")
    scored = named.join(counts, "item_id", "left").withColumn(
        "count", F.coalesce("count", F.lit(0)))
    return top_n(scored, ["cluster"], [F.desc("count"), F.col("item_id")], 1).drop("rank")


def nearest_centres(truths: DataFrame, items: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """``case_id, rank, cluster``: cluster centres closest to each truth item.

    Distances are taken once per distinct item, then joined to the cases.
    """
    wanted = items.join(truths.select("item_id").distinct(), "item_id", "left_semi")
    near = nearest(wanted.select(F.col("item_id").alias("case_id"),
                                 F.col("embedding").alias("vector")),
                   centres, k, "negative_euclidean", item="cluster", embedding="centre")
    near = near.select(F.col("case_id").alias("item_id"), "rank", "cluster")
    return truths.select("case_id", "item_id").join(near, "item_id").select(
        "case_id", "rank", "cluster")
