"""The online job over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slatewright.operators import neighbours as N
from slatewright.plans.registry.common import sql
from slatewright.plans.registry.neighbours import chain, fitted
from slatewright.session import ensure_checkpoint_dir
from slatewright.streaming import online

QUERIES: dict = {}
SQL: dict[str, str] = {}

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def online_prompts(spark, sf_dir):
    """Events replayed as a stream: last five items of each user's running session."""
    events = online.click_stream(spark, sf_dir, EVENTS, "events.parquet")
    clicks = events.select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.col("event_id").alias("order_id"))
    prompts = online.running_prompts(clicks, 5, 6 * 3600)
    base = f"{ensure_checkpoint_dir(spark)}/online-{uuid.uuid4().hex}"
    query = online.start_scoring(prompts, lambda rows: rows, f"{base}/out", f"{base}/state", once=True)
    query.awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    return found.select("case_id", "pos", "item_id")


ONLINE = N.NeighbourOptions(k=20, sample_size=60, decay="harmonic", similarity="dot")


def online_slates(spark, sf_dir):
    """Events replayed in four spans of time, every micro-batch scored from the stored index; each user's last slate."""
    base = f"{ensure_checkpoint_dir(spark)}/online-{uuid.uuid4().hex}"
    online.replay(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"), "ts", f"{base}/in", parts=4)
    clicks = online.click_stream(spark, f"{base}/in", EVENTS, files_per_batch=2).select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.col("event_id").alias("order_id"))
    prompts = online.running_prompts(clicks, 5, 6 * 3600)
    query = online.start_scoring(prompts, online.index_scorer(fitted(spark, sf_dir), 10, ONLINE), f"{base}/out", f"{base}/state", once=True)
    query.awaitTermination()
    return online.latest_slates(spark, f"{base}/out").select("case_id", "rank", "item_id", "score")


LAST_PROMPTS = """
  e AS (SELECT user_id, ts, event_id, json_extract_string(props, '$.k')::BIGINT AS item_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
               lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events),
  g AS (SELECT *, sum(CASE WHEN next_ts IS NOT NULL AND epoch_us(next_ts) - epoch_us(ts) > 21600000000 THEN 1 ELSE 0 END)
          OVER (PARTITION BY user_id ORDER BY back) AS older FROM e),
  k AS (SELECT * FROM g WHERE older = 0 AND back <= 5),
  online AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY back DESC) AS pos, item_id FROM k)"""

QUERIES["online_prompts_st1"] = online_prompts
SQL["online_prompts_st1"] = sql(f"WITH {LAST_PROMPTS} SELECT case_id, pos, item_id FROM online")
QUERIES["online_slates_st1"] = online_slates
SQL["online_slates_st1"] = sql(
    f", {LAST_PROMPTS},{chain(ONLINE, 'train', 'online')} SELECT case_id, rank, item_id, score FROM ranked WHERE rank <= 10", "train")
