"""Online prompts: the latest items of every running session, from a click stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slatewright.operators.neighbours import NeighbourIndex, NeighbourOptions, recommend_neighbours
from slatewright.session import cut_lineage

PROMPT_SCHEMA = "case_id long, items array<long>, last_us long, closed boolean"
STATE_SCHEMA = "items array<long>, times array<long>, orders array<long>"


def running_prompts(clicks: DataFrame, n_items: int, gap_seconds: int,
                    watermark: str = "1 hour") -> DataFrame:
    """``case_id, items, last_us, closed``: one row per session and micro-batch with news.

    ``clicks`` holds ``session_id, item_id, ts, order_id``.  State keeps the last
    ``n_items`` clicks of the running session, whatever its length; a pause longer than
    ``gap_seconds`` starts a new session. A session that ends so within a micro-batch is
    emitted as closed in the same one; when the watermark passes the end of the running
    one, its prompt is emitted once more as closed and its state dropped.  Clicks older
    than the watermark are not counted.
    """
    gap_us = gap_seconds * 1_000_000

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
               ) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame({"us": [], "order_id": [], "item_id": []}, dtype="int64")
        if state.exists:
            items, times, orders = state.get
            kept = pd.DataFrame({"us": times, "order_id": orders, "item_id": items})
        closed = state.hasTimedOut
        sessions = [kept]
        if not closed:
            parts = [frame[["us", "order_id", "item_id"]] for frame in frames]
            kept = pd.concat([kept, *parts] if len(kept) else parts).sort_values(["us", "order_id"])
            number = (kept["us"].diff().fillna(0) > gap_us).cumsum()
            sessions = [part.tail(n_items) for _, part in kept.groupby(number)]
            kept = sessions[-1]
        row = pd.DataFrame({"case_id": key[0], "items": [s["item_id"].astype("int64").tolist() for s in sessions],
                            "last_us": [int(s["us"].iloc[-1]) for s in sessions],
                            "closed": [True] * (len(sessions) - 1) + [closed]})
        if closed:
            state.remove()
        else:
            state.update(tuple([int(v) for v in kept[c]] for c in ("item_id", "us", "order_id")))
            end_ms = (int(kept["us"].iloc[-1]) + gap_us) // 1000
            state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))
        yield row

    timed = (clicks.withWatermark("ts", watermark)
             .withColumn("us", F.unix_micros("ts")))
    return timed.groupBy("session_id").applyInPandasWithState(
        update, PROMPT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def prompt_rows(prompts: DataFrame) -> DataFrame:
    """``case_id, pos, item_id`` of running sessions, as the batch recommenders take them."""
    latest = prompts.where(~F.col("closed")).groupBy("case_id").agg(
        F.max_by("items", "last_us").alias("items"))
    return latest.select("case_id", F.posexplode("items").alias("_at", "item_id")).select(
        "case_id", (F.col("_at") + 1).cast("long").alias("pos"), "item_id")


def start_scoring(prompts: DataFrame, score: Callable[[DataFrame], DataFrame], path: str,
                  checkpoint: str, once: bool = False):
    """Score each micro-batch of prompts and write the slates below ``path``.

    The batch number is a partition that is overwritten when a batch is repeated after a
    failure, so every batch is stored exactly once.
    """
    def handle(batch: DataFrame, number: int) -> None:
        rows = cut_lineage(prompt_rows(batch))  # scoring reads them several times, the stream is evaluated once
        score(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = prompts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def index_scorer(index: NeighbourIndex, k: int, options: NeighbourOptions = NeighbourOptions()) -> Callable[[DataFrame], DataFrame]:
    """Slates of prompts from a stored index: a batch's prompts meet the index's buckets, and no log is read.

    A prompt without any slate has one row without rank, so that it replaces an older slate of its case.
    """
    def score(rows: DataFrame) -> DataFrame:
        slates = recommend_neighbours(rows, index, k, options).drop("model")
        return rows.select("case_id").distinct().join(slates, "case_id", "left")

    return score


def latest_slates(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, rank, item_id, score``: of each case what its last batch with news stored."""
    stored = spark.read.parquet(path)
    last = stored.groupBy("case_id").agg(F.max("batch").alias("batch"))
    return stored.join(last, ["case_id", "batch"]).where("rank IS NOT NULL").drop("batch")


def replay(events: DataFrame, time: str, path: str, parts: int, files: int = 2) -> None:
    """Stores a table below ``path`` as clicks would arrive: ``parts`` spans of time, one after the other, each in
    ``files`` files."""
    low, high = events.agg(F.min(F.unix_micros(F.col(time).cast("timestamp"))), F.max(F.unix_micros(F.col(time).cast("timestamp")))).first()
    if low is None:
        return
    step = (high - low) // parts + 1
    part = F.floor((F.unix_micros(F.col(time).cast("timestamp")) - low) / step)
    for i in range(parts):
        events.where(part == i).repartition(files).write.mode("append").parquet(path)


def click_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*",
                 files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))
