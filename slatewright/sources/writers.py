"""Sinks: sessions, items, mappings, recommendations, chat examples, results, bundles."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewright.sources.readers import SESSION_TIME_FORMAT


def write_sessions(log: DataFrame, path: str, fmt: str = "parquet") -> None:
    """``session_id, item_id, ts, reward``; CSV uses the session file's names and format."""
    if fmt == "parquet":
        log.write.mode("overwrite").parquet(path)
        return
    log.select(F.col("session_id").alias("SessionId"), F.col("item_id").alias("ItemId"),
               F.date_format("ts", SESSION_TIME_FORMAT).alias("Time"),
               F.col("reward").alias("Reward")).write.mode("overwrite").option(
        "header", True).csv(path)


def write_items(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").parquet(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    """Id mapping as JSON lines."""
    mapping.write.mode("overwrite").json(path)


def write_recommendations(recs: DataFrame, path: str, config: dict,
                          run_ts: str | None = None) -> str:
    """Append a run, partitioned by model and time, with its settings as a column."""
    stamp = run_ts or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    (recs.withColumns({"run_ts": F.lit(stamp), "config": F.lit(json.dumps(config, sort_keys=True))})
     .write.mode("append").partitionBy("model", "run_ts").parquet(path))
    return stamp


def write_chat_examples(lines: DataFrame, path: str) -> None:
    """JSON lines below ``split=train`` and ``split=validation``."""
    lines.select("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def write_results(table: DataFrame, path: str) -> None:
    """A results table (one row per setting) as a single CSV file."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


BUNDLE_TABLES = ("log", "train", "test", "prompts", "truths", "folds", "items")


def write_bundle(tables: dict[str, DataFrame], path: str, spark: SparkSession) -> None:
    """A prepared dataset: one parquet table each and a manifest of what is there."""
    unknown = set(tables) - set(BUNDLE_TABLES)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = spark.createDataFrame(
        [(name, table.schema.json()) for name, table in tables.items()], "name string, schema string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    manifest = spark.read.schema("name string, schema string").json(f"{path}/manifest")
    names = [row["name"] for row in manifest.select("name").collect()]
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
