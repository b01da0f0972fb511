"""What neighbour recommenders learn from a training log, stored so that prompts need no log.

Tables lie in buckets by the column they are joined on: lists of an item's sessions by item, a
session's items and clicks by session. A stored index is found again by its path.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewright.operators.ranking import rank_within

#: Rows of a table in one bucket, and the least number of buckets.
BUCKET_ROWS = 5_000_000

#: Of each table the column it's bucketed by and the order inside a bucket.
LAYOUT = {"postings": ("item_id", ("item_id", "number")), "cells": ("session_id", ("session_id", "item_id")),
          "items": ("item_id", ("item_id",)), "follow": ("item_id", ("item_id", "next_item")),
          "sequence": ("session_id", ("session_id", "pos"))}


def session_item_weights(train: DataFrame) -> DataFrame:
    """``session_id, item_id, w``: summed integer reward of each cell."""
    return train.groupBy("session_id", "item_id").agg(
        F.sum(F.col("reward").cast("long")).cast("double").alias("w"))


def inverse_frequency(weights: DataFrame) -> DataFrame:
    """``item_id, df, idf`` with ``idf = 1 + ln(sessions / df)``."""
    total = weights.select("session_id").distinct().agg(F.count(F.lit(1))).scalar()
    counted = weights.groupBy("item_id").agg(F.count(F.lit(1)).alias("df"))
    return counted.withColumn("idf", F.lit(1.0) + F.log(total.cast("double") / F.col("df")))


def successors(train: DataFrame) -> DataFrame:
    """``item_id, next_item``: items that follow an item immediately, once each.

    Joined on (session, position), which spreads long sessions over all tasks.
    """
    here = train.select("session_id", "pos", "item_id")
    there = train.select("session_id", (F.col("pos") - 1).alias("pos"),
                         F.col("item_id").alias("next_item"))
    return here.join(there, ["session_id", "pos"]).select("item_id", "next_item").distinct()


def described_weights(train: DataFrame) -> DataFrame:
    """Cell weights with the norm, size and end time of their session."""
    weights = session_item_weights(train)
    per_session = weights.groupBy("session_id").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s_norm"),
        F.count(F.lit(1)).alias("s_size"))
    ends = train.groupBy("session_id").agg(F.max("ts").alias("s_end"))
    return weights.join(per_session.join(ends, "session_id"), "session_id")


@dataclass(frozen=True)
class NeighbourIndex:
    """Tables of a fitted neighbour recommender.

    ``postings`` (item_id, number, session_id, w, s_norm, s_size, s_end): each item's sessions, numbered from 1, the
    latest first. ``cells``: the same rows by session. ``items`` (item_id, df, idf); ``follow`` (item_id, next_item);
    ``sequence`` (session_id, pos, n, item_id): the clicks in order.
    """

    postings: DataFrame
    cells: DataFrame
    items: DataFrame
    follow: DataFrame
    sequence: DataFrame

    @staticmethod
    def of(train: DataFrame) -> NeighbourIndex:
        """The index of a log (session_id, item_id, ts, reward, pos), not stored."""
        cells = described_weights(train)
        sizes = cells.groupBy("item_id").agg(F.count(F.lit(1)).alias("_rows"))
        postings = rank_within(cells, ["item_id"], [F.desc("s_end"), F.desc("session_id")], "number", sizes=sizes)
        lengths = train.groupBy("session_id").agg(F.max("pos").alias("n"))
        sequence = train.select("session_id", "pos", "item_id").join(lengths, "session_id")
        return NeighbourIndex(postings, cells, inverse_frequency(cells), successors(train), sequence)

    @staticmethod
    def fit(train: DataFrame, path: str) -> NeighbourIndex:
        """Builds the index of ``train``, stores it below ``path``, and returns the stored one."""
        spark, built, written = train.sparkSession, NeighbourIndex.of(train), {}
        rows = built.cells.count()
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(least, -(-rows // BUCKET_ROWS))
        for name, (by, order) in LAYOUT.items():
            table = getattr(built, name)
            if name == "cells":  # by session from the numbered lists, so that the weights are computed once
                table = written["postings"].drop("number")
            elif name == "items":
                table = inverse_frequency(written["cells"])
            # one file a bucket: rows come to the task that writes theirs
            (table.repartition(buckets, by).write.format("parquet").option("path", f"{path}/{name}")
             .bucketBy(buckets, by).sortBy(*order).saveAsTable(written_name := f"neighbours_{uuid.uuid4().hex}"))
            written[name] = spark.table(written_name)
        meta = {name: {"buckets": buckets, "schema": written[name].schema.simpleString()} for name in LAYOUT}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")
        return NeighbourIndex(**written)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NeighbourIndex:
        """The index stored below ``path``, also by another application."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        tables = {}
        for field in fields(NeighbourIndex):
            by, order = LAYOUT[field.name]
            columns = meta[field.name]["schema"][len("struct<"):-1].replace(":", " ")
            name = f"neighbours_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({', '.join(order)}) "
                      f"INTO {meta[field.name]['buckets']} BUCKETS LOCATION '{path}/{field.name}'")
            tables[field.name] = spark.table(name)
        return NeighbourIndex(**tables)
