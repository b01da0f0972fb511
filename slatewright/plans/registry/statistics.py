"""Queries on logs, popularity and embeddings as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewright.operators import stats
from slatewright.plans import workload
from slatewright.plans.prepared import dataset, log_table
from slatewright.plans.registry.common import sql
from slatewright.plans.registry.evaluating import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, query, text=None, *needs):
    QUERIES[name] = query
    if text is not None:
        SQL[name] = sql(text, *needs)


add("log_summary_a1_a3", lambda s, d: rounded(stats.log_summary(log_table(s, d)), "mean_length"), """
  SELECT count(DISTINCT session_id) AS n_sessions, count(*) AS n_interactions,
         round(count(*) / count(DISTINCT session_id), 6) AS mean_length,
         count(DISTINCT item_id) AS n_items FROM raw_log""", "raw_log")

add("rows_per_session_a2", lambda s, d: stats.rows_per(log_table(s, d), "session_id"),
    "SELECT session_id, count(*) AS n FROM raw_log GROUP BY 1", "raw_log")

add("item_frequency_a4", lambda s, d: rounded(stats.item_frequency(log_table(s, d)), "share", digits=9), """
  SELECT item_id, round(count(*) / (SELECT count(*) FROM raw_log), 9) AS share FROM raw_log GROUP BY 1""",
    "raw_log")

_NAMES = "[" + ", ".join(f"'{5 * i}%'" for i in range(21)) + "]"
_QS = "[" + ", ".join(repr(q) for q in stats.PERCENTILES) + "]"
SUMMARY = f"""
  stat AS (SELECT count(*)::DOUBLE AS c, avg(n) AS m, stddev_samp(n) AS s, min(n)::DOUBLE AS lo,
              max(n)::DOUBLE AS hi, quantile_cont(n, {_QS}) AS p FROM sizes)
  SELECT statistic, round(value, 6) AS value FROM (
    SELECT 'count' AS statistic, c AS value FROM stat UNION ALL SELECT 'mean', m FROM stat
    UNION ALL SELECT 'std', s FROM stat UNION ALL SELECT 'min', lo FROM stat
    UNION ALL SELECT 'max', hi FROM stat
    UNION ALL SELECT unnest({_NAMES}), unnest(p)::DOUBLE FROM stat)"""

add("session_length_summary_a4", lambda s, d: rounded(
    stats.session_length_summary(log_table(s, d)), "value"),
    ", sizes AS (SELECT count(*) AS n FROM raw_log GROUP BY session_id)," + SUMMARY, "raw_log")

add("length_histogram_a5", lambda s, d: stats.length_histogram(log_table(s, d), 40), """
  SELECT least(n, 41)::BIGINT AS length, count(*) AS n_sessions FROM ends GROUP BY 1""", "ends")

add("popularity_curve_a6", lambda s, d: stats.popularity_curve(log_table(s, d)), """
  SELECT row_number() OVER (ORDER BY count(*) DESC, item_id) AS place, item_id, count(*) AS n
  FROM raw_log GROUP BY item_id""", "raw_log")

add("prompt_length_summary_a7", lambda s, d: rounded(stats.summary_of(
    dataset(s, d).prompts.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))), "value"),
    ", sizes AS (SELECT count(*) AS n FROM prompts GROUP BY case_id)," + SUMMARY, "prompts")

add("norm_range_a8", lambda s, d: rounded(stats.norm_range(workload.vectors(s, d)), "min_norm", "max_norm"),
    """
  SELECT round(min(sqrt(list_inner_product(v, v))), 6) AS min_norm,
         round(max(sqrt(list_inner_product(v, v))), 6) AS max_norm FROM vecs""", "vecs")

add("pair_distances_a9", lambda s, d: rounded(
    stats.pair_distance_summary(workload.vectors(s, d)), "value"), """
  , pd AS (SELECT 1 - list_cosine_similarity(x.v, y.v) AS d FROM vecs x JOIN vecs y ON x.item_id < y.item_id)
  SELECT statistic, round(value, 6) AS value FROM (
    SELECT 'mean' AS statistic, avg(d) AS value FROM pd UNION ALL SELECT 'std', stddev_pop(d) FROM pd
    UNION ALL SELECT 'min', min(d) FROM pd UNION ALL SELECT 'max', max(d) FROM pd
    UNION ALL SELECT 'q25', quantile_cont(d, 0.25) FROM pd
    UNION ALL SELECT 'median', quantile_cont(d, 0.5) FROM pd
    UNION ALL SELECT 'q75', quantile_cont(d, 0.75) FROM pd)""", "vecs")

add("neighbour_distances_a10", lambda s, d: rounded(stats.neighbour_distance_summary(
    workload.vectors(s, d)), "mean", "std", "min", "max"), """
  , near AS (SELECT x.item_id, round(list_cosine_similarity(x.v, y.v), 9) AS c, row_number() OVER (
       PARTITION BY x.item_id ORDER BY round(list_cosine_similarity(x.v, y.v), 9) DESC, y.item_id) AS rn
       FROM vecs x JOIN vecs y ON x.item_id <> y.item_id),
  per AS (SELECT item_id, avg(1 - c) AS m, stddev_pop(1 - c) AS s, min(1 - c) AS lo, max(1 - c) AS hi
          FROM near WHERE rn <= 10 GROUP BY 1)
  SELECT round(avg(m), 6) AS mean, round(avg(s), 6) AS std, round(avg(lo), 6) AS min,
         round(avg(hi), 6) AS max FROM per""", "vecs")


def rolling(spark, sf_dir):
    """Order totals in key order as a training curve; the whole table is one series."""
    from slatewright.operators.ranking import rank_overall
    orders = workload.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    series = rank_overall(orders, [F.col("o_orderkey")], name="n").withColumn("step", F.col("n") - 1)
    return rounded(stats.rolling_mean(series, "o_totalprice", chunk=1024).select("step", "rolling"),
                   "rolling", digits=8)


add("rolling_mean_a12", rolling, """
  SELECT step, round(CASE WHEN step >= 63 THEN avg(o_totalprice) OVER (
           ORDER BY step ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) END, 8) AS rolling
  FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS step, o_totalprice FROM orders)""")

POP = """popularity AS (SELECT item_id, count(DISTINCT session_id) /
   (SELECT count(DISTINCT session_id) FROM train) AS p FROM train GROUP BY 1)"""

add("session_popularity_a13", lambda s, d: rounded(
    stats.session_popularity(dataset(s, d).train), "popularity", digits=9),
    f", {POP} SELECT item_id, round(p, 9) AS popularity FROM popularity", "train")

QUANTILES = (0.1, 0.25, 0.5, 0.9)
add("popularity_cutoffs_a14", lambda s, d: rounded(stats.popularity_cutoffs(
    stats.session_popularity(dataset(s, d).train), QUANTILES), "cutoff", digits=9), f", {POP}" + """
  SELECT unnest([0.1, 0.25, 0.5, 0.9])::DOUBLE AS quantile,
         round(unnest(quantile_cont(p, [0.1, 0.25, 0.5, 0.9])), 9) AS cutoff FROM popularity""", "train")


def similarity_cutoffs(spark, sf_dir):
    values = stats.similarity_cutoffs(workload.vectors(spark, sf_dir), QUANTILES)
    rows = [(q, round(v, 6)) for q, v in zip(QUANTILES, values)]
    return spark.createDataFrame(rows, "quantile double, cutoff double")


add("similarity_cutoffs_a15", similarity_cutoffs, """
  , pd AS (SELECT list_cosine_similarity(x.v, y.v) AS c FROM vecs x JOIN vecs y ON x.item_id <> y.item_id)
  SELECT unnest([0.1, 0.25, 0.5, 0.9])::DOUBLE AS quantile,
         round(unnest(quantile_cont(c, [0.1, 0.25, 0.5, 0.9])), 6) AS cutoff FROM pd""", "vecs")

add("length_percentile_q7", lambda s, d: stats.length_percentile(dataset(s, d).train, 0.95), """
  SELECT quantile_cont(n, 0.95)::DOUBLE AS length FROM (SELECT count(*) AS n FROM train GROUP BY session_id)""",
    "train")
