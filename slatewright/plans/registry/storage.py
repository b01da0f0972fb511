"""Queries that write to the shared folder and read back what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slatewright.operators import evaluation as E
from slatewright.operators.embedding import embeddings_through_cache
from slatewright.plans import workload
from slatewright.plans.prepared import dataset, log_table
from slatewright.plans.registry.common import sql
from slatewright.plans.registry.evaluating import NEED, RECS, rounded, two_model_report, two_models, with_recs
from slatewright.plans.registry.preparation import MAP, mapping
from slatewright.session import ensure_checkpoint_dir
from slatewright.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, query, text=None, *needs):
    QUERIES[name] = query
    if text is not None:
        SQL[name] = sql(text, *needs)


def folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sessions(spark, sf_dir):
    path = folder(spark, "sessions")
    writers.write_sessions(log_table(spark, sf_dir), path, "csv")
    return readers.read_sessions(spark, path).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("items"), F.sum("reward").alias("reward"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


add("session_files_s1_s7", sessions, """
  SELECT session_id, count(*) AS n, sum(item_id)::BIGINT AS items, sum(reward) AS reward,
         strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM raw_log GROUP BY 1""", "raw_log")


def review_files(spark, sf_dir):
    """Orders as a folder of JSON-lines reviews."""
    path = folder(spark, "reviews")
    workload.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("reviewerID"), F.col("o_orderkey").cast("string").alias("asin"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', o_orderdate)").alias("unixReviewTime")).write.json(path)
    return readers.read_reviews(spark, path)


add("review_files_s2", review_files, """
  SELECT o_custkey::VARCHAR AS user, o_orderkey::VARCHAR AS item,
         epoch(o_orderdate)::BIGINT AS unix_time, 1.0::DOUBLE AS reward FROM orders""")


def lookup_files(spark, sf_dir):
    path = folder(spark, "lookup")
    workload.names(spark, sf_dir).withColumn("other", F.lit("x")).write.option("header", True).csv(path)
    return readers.read_lookup(spark, path, ["item_id", "name"]).withColumn("item_id", F.col("item_id").cast("long"))


add("lookup_files_s6", lookup_files, """
  SELECT p_partkey AS item_id, p_name || ' #' || p_partkey AS name FROM part""")


def embedding_write_back(spark, sf_dir):
    """Names of small parts, then all names, through one cache table; the embedder counts characters."""
    path = folder(spark, "cache")
    part = workload.table(spark, sf_dir, "part")
    letters = lambda mark: lambda texts: [[len(t), mark] for t in texts]
    small = part.where("p_size < 20").select(F.col("p_name").alias("text"))
    embeddings_through_cache(small, path, "letters", letters(0.0))
    everything = embeddings_through_cache(part.select(F.col("p_name").alias("text")), path, "letters", letters(1.0))
    return everything.select("text", F.col("embedding")[0].alias("n"), F.col("embedding")[1].alias("fresh"))


add("embedding_write_back_e13", embedding_write_back, """
  SELECT p_name AS text, length(p_name)::DOUBLE AS n, min(CASE WHEN p_size < 20 THEN 0.0 ELSE 1.0 END)::DOUBLE AS fresh
  FROM part GROUP BY 1""")


def mappings(spark, sf_dir):
    path = folder(spark, "mapping")
    writers.write_mapping(mapping(spark, sf_dir), path)
    return spark.read.schema("item_id long, idx long").json(path)


add("mapping_files_s8", mappings, f", {MAP} SELECT item_id, idx FROM mapping", "raw_log")


def embedding_files(spark, sf_dir):
    """Item vectors as compressed CSV with JSON vectors, attached to their names."""
    path = folder(spark, "vectors")
    items = workload.vectors(spark, sf_dir).join(workload.names(spark, sf_dir), "item_id")
    items.select(F.col("item_id").alias("ItemId"), "name", F.to_json("embedding").alias("embedding")).write.option(
        "header", True).option("escape", '"').option("compression", "gzip").csv(path)
    return readers.read_embeddings(spark, path).select(
        "item_id", "name", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, b: a + F.abs(b)), 6).alias("mass"))


# Test items that no part names are left out by the join, as are parts without a vector.
add("embedding_files_s5", embedding_files, """
  SELECT vec_id AS item_id, p_name || ' #' || p_partkey AS name, len(embedding)::INTEGER AS dim,
         round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 6) AS mass
  FROM embeddings JOIN part ON p_partkey = vec_id""")


def bundle(spark, sf_dir):
    path = folder(spark, "bundle")
    data = dataset(spark, sf_dir).with_items(workload.names(spark, sf_dir))
    writers.write_bundle({"train": data.train, "test": data.test, "prompts": data.prompts,
                          "truths": data.truths, "items": data.item_table()}, path, spark)
    tables = writers.read_bundle(spark, path)
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("item_id").alias("items")).select(
        F.lit(name).alias("part"), "n_rows", "items") for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


add("dataset_bundle_s9_s15", bundle, " UNION ALL ".join(
    f"SELECT '{label}' AS part, count(*) AS n_rows, sum(item_id)::BIGINT AS items FROM {source}"
    for label, source in (("train", "train"), ("test", "test"), ("prompts", "prompts"), ("truths", "truths"),
                          ("items", "(SELECT p_partkey AS item_id FROM part)"))),
    "train", "test", "prompts", "truths")


def stored_runs(spark, sf_dir):
    path = folder(spark, "runs")
    _, recs = two_models(spark, sf_dir)
    writers.write_recommendations(recs, path, {"k": 20}, "run1")
    return readers.read_recommendations(spark, path).select(
        "model", "run_ts", "case_id", "rank", "item_id", F.get_json_object("config", "$.k").alias("k"))


add("stored_runs_s10_s11", stored_runs, f""",{RECS}
  SELECT model, 'run1' AS run_ts, case_id, rank, item_id, '20' AS k FROM recs""", *NEED)


def results_files(spark, sf_dir):
    """Metric rows as CSV files (one with gaps), read together, complete rows only."""
    path = folder(spark, "results")
    report = rounded(two_model_report(spark, sf_dir), "value")
    gaps = report.withColumn("value", F.when(F.col("top_k") == 10, F.col("value")))
    writers.write_results(report, f"{path}/a")
    writers.write_results(gaps, f"{path}/b")
    back = readers.read_metric_files(spark, [f"{path}/a", f"{path}/b"],
                                     "model string, top_k int, metric string, value double", ["value"])
    return rounded(E.average_reports(back), "value").join(
        back.groupBy("model", "top_k", "metric").agg(F.count(F.lit(1)).alias("n")), ["model", "top_k", "metric"])


add("results_files_s13_s14", results_files, with_recs("""
  SELECT model, top_k, metric, round(value, 6) AS value, CASE WHEN top_k = 10 THEN 2 ELSE 1 END::BIGINT AS n
  FROM report"""), *NEED)


def model_names(spark, sf_dir):
    path = folder(spark, "named")
    _, recs = two_models(spark, sf_dir)
    for model in ("popular", "follow"):
        recs.where(F.col("model") == model).drop("model").coalesce(1).write.parquet(f"{path}/{model}")
    files = spark.read.parquet(f"{path}/*")
    name = readers.model_from_file(F.concat(
        F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1), F.lit("-2024.parquet")))
    named = files.select(F.concat(F.lit("/"), name).alias("m"), "case_id")
    return named.groupBy(F.substring("m", 2, 100).alias("model")).agg(F.count(F.lit(1)).alias("n"))


add("models_from_files_s11", model_names, f""",{RECS}
  SELECT model, count(*) AS n FROM recs GROUP BY 1""", *NEED)
