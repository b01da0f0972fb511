"""Queries on popularity slates and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewright.operators import cases, splitting
from slatewright.operators import evaluation as E
from slatewright.operators import popularity as P
from slatewright.operators.metrics import Metric
from slatewright.operators.ranking import top_n
from slatewright.plans.prepared import dataset
from slatewright.plans.registry.common import metrics_sql, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def popular_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = dataset(spark, sf_dir)
    counts = P.item_counts(data.train)
    recs = P.recommend_popular(data.train, data.case_ids(), 20)
    n_items = counts.agg(F.count(F.lit(1))).scalar()
    report = E.evaluate(recs, data.truths, (10, 20), E.ALL_METRICS, item_counts=counts,
                        n_items=n_items)
    return rounded(report, "value")


QUERIES["popular_report_n2"] = popular_report
SQL["popular_report_n2"] = sql(
    ", recs AS (SELECT 'popular' AS model, case_id, rank, popular.item_id FROM truths, popular WHERE rank <= 20),"
    + metrics_sql("recs", "truths", "counts")
    + " SELECT model, top_k, metric, round(value, 6) AS value FROM report",
    "truths", "popular")


def add(name, query, text=None, *needs):
    QUERIES[name] = query
    if text is not None:
        SQL[name] = sql(text, *needs)


# Two models for comparisons: overall popularity and popularity by last prompt item.
def two_models(spark, sf_dir, k=20):
    """``popular`` for every case and ``follow``: most frequent direct successors."""
    data = dataset(spark, sf_dir)
    popular = P.recommend_popular(data.train, data.case_ids(), k)
    here = data.train.select("session_id", "pos", "item_id")
    there = data.train.select("session_id", (F.col("pos") - 1).alias("pos"),
                              F.col("item_id").alias("next_item"))
    votes = here.join(there, ["session_id", "pos"]).groupBy("item_id", "next_item").agg(
        F.count(F.lit(1)).alias("votes"))
    best = top_n(votes, ["item_id"], [F.desc("votes"), F.col("next_item")], k)
    last = data.prompts.withColumn("n", F.max("pos").over(Window.partitionBy("case_id"))).where(
        "pos = n").select("case_id", "item_id")
    follow = last.join(best, "item_id").select(
        F.lit("follow").alias("model"), "case_id", "rank", F.col("next_item").alias("item_id"),
        F.col("votes").cast("double").alias("score"))
    return data, popular.unionByName(follow)


RECS = """
  follows AS (SELECT item_id, next_item, count(*) AS votes, row_number() OVER (
      PARTITION BY item_id ORDER BY count(*) DESC, next_item) AS rank
    FROM (SELECT item_id, lead(item_id) OVER (PARTITION BY session_id ORDER BY pos) AS next_item FROM train)
    WHERE next_item IS NOT NULL GROUP BY 1, 2),
  lasts AS (SELECT case_id, arg_max(item_id, pos) AS item_id FROM prompts GROUP BY 1),
  recs AS (SELECT 'popular' AS model, case_id, rank, popular.item_id, c::DOUBLE AS score
           FROM truths, popular WHERE rank <= 20
           UNION ALL SELECT 'follow', case_id, rank, next_item, votes::DOUBLE
           FROM lasts JOIN follows USING (item_id) WHERE rank <= 20)"""
NEED = ("train", "prompts", "truths", "popular")


def with_recs(body):
    return f",{RECS},{metrics_sql('recs', 'truths', 'counts')}\n{body}"


def two_model_report(spark, sf_dir):
    data, recs = two_models(spark, sf_dir)
    counts = P.item_counts(data.train)
    return E.evaluate(recs, data.truths, (10, 20), E.ALL_METRICS, item_counts=counts,
                      n_items=counts.agg(F.count(F.lit(1))).scalar())


add("model_report_n1_n6", lambda s, d: rounded(two_model_report(s, d), "value"),
    with_recs("SELECT model, top_k, metric, round(value, 6) AS value FROM report"), *NEED)


def cases_query(spark, sf_dir):
    data, recs = two_models(spark, sf_dir)
    out = E.per_case(recs, data.truths, (10, 20), ("NDCG", "HitRate", "MRR", "Serendipity", "Novelty"),
                     item_counts=P.item_counts(data.train))
    return rounded(out, "NDCG", "HitRate", "MRR", "Serendipity", "Novelty")


add("case_values_n3_n4_n5_n7_n8_n11", cases_query, with_recs("""
  SELECT model, case_id, top_k, round(ndcg, 6) AS "NDCG", hr AS "HitRate", round(mrr, 6) AS "MRR",
         round(ser, 6) AS "Serendipity", round(nov, 6) AS "Novelty" FROM case_values"""), *NEED)


def several_truths(spark, sf_dir):
    """Three withheld items per session, ideal gain and serendipity over several truths."""
    data = dataset(spark, sf_dir)
    counts = P.item_counts(data.train)
    recs = P.recommend_popular(data.train, data.case_ids(), 100)
    truths = cases.ground_truths(data.test, 3)
    return rounded(E.evaluate(recs, truths, (20, 100), ("NDCG", "HitRate", "MRR", "Serendipity", "Novelty"),
                              item_counts=counts), "value")


add("several_truths_n4_n5_n7", several_truths, """
  , t3 AS (SELECT session_id AS case_id, item_id FROM test WHERE pos > n - 3 AND n > 3),
  recs AS (SELECT 'popular' AS model, case_id, rank, popular.item_id FROM (SELECT DISTINCT case_id FROM t3), popular
           WHERE rank <= 100),""" + metrics_sql("recs", "t3", "counts", (20, 100)) + """
  SELECT model, top_k, metric, round(value, 6) AS value FROM report WHERE metric <> 'Catalog coverage'""",
    "test", "popular")


def repeated_slates(spark, sf_dir):
    """Slates with every item twice: cut to k first, then de-duplicated."""
    data = dataset(spark, sf_dir)
    recs = P.recommend_popular(data.train, data.case_ids(), 20)
    doubled = recs.withColumn("rank", F.explode(F.array(F.col("rank") * 2 - 1, F.col("rank") * 2)))
    return rounded(E.evaluate(doubled, data.truths, (10, 20), ("NDCG", "MRR", "Novelty"),
                              item_counts=P.item_counts(data.train)), "value")


add("repeated_slates_n1", repeated_slates, """
  , recs AS (SELECT 'popular' AS model, case_id, 2 * rank - d AS rank, popular.item_id
             FROM truths, popular, range(0, 2) r(d) WHERE rank <= 20),""" +
    metrics_sql("recs", "truths", "counts") + """
  SELECT model, top_k, metric, round(value, 6) AS value FROM report
  WHERE metric IN ('NDCG', 'MRR', 'Novelty')""", "truths", "popular")


def fold_reports(spark, sf_dir):
    """Popularity fitted and judged per fold of a forward-chaining split, all folds at once."""
    data = dataset(spark, sf_dir)
    folds = splitting.forward_chaining_folds(data.train, 3)
    labelled = splitting.with_roles(data.train, folds)
    train = labelled.where("role = 'train'")
    test = splitting.drop_untrained(train, labelled.where("role = 'validation'"), ["fold"])
    truths = cases.ground_truths(test, 1, ["fold"]).select(
        "fold", (F.col("case_id") * 10 + F.col("fold")).alias("case_id"), "item_id")
    counts = train.groupBy("fold", "item_id").agg(F.count(F.lit(1)).alias("count"))
    best = top_n(counts, ["fold"], [F.desc("count"), F.col("item_id")], 20)
    recs = truths.select("fold", "case_id").join(best, "fold").select(
        F.lit("popular").alias("model"), "fold", "case_id", "rank", "item_id")
    return E.evaluate(recs, truths, (10, 20), E.RANKING, keys=("model", "fold"))


FOLDS = """
  , binned AS (SELECT session_id, ntile(4) OVER (ORDER BY max(ts), session_id) AS bin FROM train GROUP BY 1),
  lab AS (SELECT t.*, f.fold, CASE WHEN bin <= fold THEN 'train' ELSE 'validation' END AS role
          FROM train t JOIN binned USING (session_id), range(1, 4) f(fold) WHERE bin <= fold + 1),
  ftest AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fold, session_id) AS m,
              row_number() OVER (PARTITION BY fold, session_id ORDER BY pos DESC) AS back FROM lab l
            WHERE role = 'validation' AND EXISTS (SELECT 1 FROM lab k WHERE k.role = 'train'
                  AND k.fold = l.fold AND k.item_id = l.item_id)) WHERE m >= 2),
  ftruth AS (SELECT session_id * 10 + fold AS case_id, fold, item_id FROM ftest WHERE back = 1),
  fpop AS (SELECT fold, item_id, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, item_id) AS rank
           FROM lab WHERE role = 'train' GROUP BY 1, 2),
  hit AS (SELECT t.fold, case_id, k.top_k, any_value(CASE WHEN rank <= k.top_k THEN rank END) AS r
          FROM ftruth t CROSS JOIN (VALUES (10), (20)) k(top_k)
          LEFT JOIN fpop p ON p.fold = t.fold AND p.item_id = t.item_id GROUP BY 1, 2, 3),
  frep AS (SELECT fold, top_k, 'NDCG' AS metric, avg(coalesce(1 / log2(r + 1.0), 0)) AS value FROM hit GROUP BY 1, 2
           UNION ALL SELECT fold, top_k, 'HitRate', avg((r IS NOT NULL)::INT) FROM hit GROUP BY 1, 2
           UNION ALL SELECT fold, top_k, 'MRR', avg(coalesce(1.0 / r, 0)) FROM hit GROUP BY 1, 2)"""
add("fold_reports_n12", lambda s, d: rounded(fold_reports(s, d), "value"), FOLDS + """
  SELECT 'popular' AS model, fold::INTEGER AS fold, top_k, metric, round(value, 6) AS value FROM frep""", "train")
add("average_reports_n13", lambda s, d: rounded(E.average_reports(fold_reports(s, d)), "value"), FOLDS + """
  SELECT 'popular' AS model, top_k, metric, round(avg(value), 6) AS value FROM frep GROUP BY 2, 3""", "train")
add("best_fold_n17", lambda s, d: rounded(E.best_trial(
    fold_reports(s, d).withColumnRenamed("fold", "trial")), "value"), FOLDS + """
  SELECT 'popular' AS model, arg_max(fold, value)::INTEGER AS trial, round(max(value), 6) AS value
  FROM (SELECT * FROM frep WHERE metric = 'NDCG' AND top_k = 20 ORDER BY fold)""", "train")

add("report_table_n14_n18", lambda s, d: E.report_table(
    rounded(two_model_report(s, d), "value"), (10, 20), E.ALL_METRICS), with_recs(
    "SELECT model, " + ", ".join(
        f"max(CASE WHEN metric = '{m}' AND top_k = {k} THEN round(value, 6) END) AS \"{m}@{k}\""
        for k in (10, 20) for m in E.ALL_METRICS) + " FROM report GROUP BY 1"), *NEED)
add("best_flags_n14", lambda s, d: E.flag_best(rounded(two_model_report(s, d), "value")), with_recs("""
  SELECT model, top_k, metric, round(value, 6) AS value,
         rank() OVER (PARTITION BY metric, top_k ORDER BY round(value, 6) DESC) = 1 AS is_best FROM report"""), *NEED)
add("report_json_n14", lambda s, d: E.report_json(two_model_report(s, d).withColumn("value", F.col("value").cast("decimal(18,6)"))),
    with_recs("""
  SELECT model, '{' || string_agg('"' || metric || '@' || top_k || '":' || value::DECIMAL(18, 6), ',' ORDER BY metric || '@' || top_k)
         || '}' AS json FROM report GROUP BY 1"""), *NEED)


def same_names(spark, sf_dir):
    one = rounded(two_model_report(spark, sf_dir), "value")
    return E.unique_model_names([one, one])


add("unique_model_names_n14", same_names, with_recs("""
  SELECT model || suffix AS model, top_k, metric, round(value, 6) AS value
  FROM report, (VALUES (''), ('_1')) s(suffix)"""), *NEED)


def curve(spark, sf_dir):
    data, recs = two_models(spark, sf_dir)
    values = E.per_case(recs, data.truths, (10,), ("Novelty",), item_counts=P.item_counts(data.train))
    return rounded(E.case_curve(values, "Novelty"), "value").select(
        "model", "top_k", "place", "value")


add("case_curve_n15", curve, with_recs("""
  SELECT model, top_k, row_number() OVER (PARTITION BY model ORDER BY nov DESC) AS place, round(nov, 6) AS value
  FROM case_values WHERE top_k = 10"""), *NEED)
add("value_steps_n15", lambda s, d: rounded(E.sorted_case_values(cases_query(s, d), "NDCG"), "value"), with_recs("""
  SELECT model, top_k, value, n_cases, (coalesce(sum(n_cases) OVER (PARTITION BY model, top_k ORDER BY value DESC
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS place
  FROM (SELECT model, top_k, round(ndcg, 6) AS value, count(*) AS n_cases FROM case_values GROUP BY ALL)"""), *NEED)


def sampled(weighted):
    def run(spark, sf_dir):
        data = dataset(spark, sf_dir)
        counts = P.item_counts(data.train)
        recs = P.recommend_popular(data.train, data.case_ids(), 1000)
        return rounded(E.sampled_evaluate(recs, data.truths, counts, 1000, 10, 100, 42, weighted), "value")
    return run


def sampled_sql(weight):
    """Draws 0 to 1049 of each case, the first three rounds; 100 of 2 000 items need about 110."""
    return f"""
  , line AS (SELECT item_id, sum({weight}) OVER (ORDER BY item_id) - {weight} AS lo FROM counts),
  points AS (SELECT case_id, j, floor(('0x' || substr(md5('42:' || case_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                      * (SELECT sum({weight}) FROM counts))::BIGINT AS x
             FROM (SELECT DISTINCT case_id FROM truths), range(0, 1050) r(j)),
  drawn AS (SELECT case_id, item_id, row_number() OVER (PARTITION BY case_id ORDER BY min(j)) AS rn
            FROM points ASOF JOIN line ON points.x >= line.lo GROUP BY 1, 2),
  cut AS (SELECT t.case_id, p.item_id, p.rank, t.item_id = p.item_id AS hit
          FROM truths t, popular p WHERE p.rank <= 1000),
  kept AS (SELECT case_id, hit, row_number() OVER (PARTITION BY case_id ORDER BY cut.rank) AS r
           FROM cut LEFT JOIN drawn USING (case_id, item_id) WHERE hit OR rn <= 100),
  per AS (SELECT t.case_id, max(CASE WHEN hit AND r <= 10 THEN r END) AS r
          FROM truths t LEFT JOIN kept USING (case_id) GROUP BY 1)
  SELECT 'popular' AS model, 10 AS top_k, unnest(['sampled_NDCG', 'sampled_HitRate', 'sampled_MRR']) AS metric,
         round(unnest([avg(coalesce(1 / log2(r + 1.0), 0)), avg((r IS NOT NULL)::INT), avg(coalesce(1.0 / r, 0))]), 6)
         AS value FROM per"""


add("sampled_popular_n16", sampled(True), sampled_sql("c"), "truths", "popular", "counts")
add("sampled_uniform_n16", sampled(False), sampled_sql("1"), "truths", "popular", "counts")


def by_length(spark, sf_dir):
    data, recs = two_models(spark, sf_dir)
    values = E.per_case(recs, data.truths, (20,), ("HitRate",))
    lengths = data.prompts.groupBy("case_id").agg(F.count(F.lit(1)).alias("length"))
    return rounded(E.hit_rate_by_length(values, lengths, 40), "hit_rate")


add("hit_rate_by_length_a11", by_length, with_recs("""
  SELECT model, top_k, length, round(avg(hr), 6) AS hit_rate, count(*) AS n_cases
  FROM case_values JOIN (SELECT case_id, count(*) AS length FROM prompts GROUP BY 1) USING (case_id)
  WHERE top_k = 20 AND length <= 40 GROUP BY 1, 2, 3"""), *NEED)

class MedianRank(Metric):
    """Median place of the first hit, over the cases that have one; a state counts places, so it has k numbers at most."""

    name = "median rank"

    def case(self, case):
        return min(case.hits) if case.hits else None

    def start(self):
        return {}

    def update(self, state, value):
        return state if value is None else {**state, value: state.get(value, 0) + 1}

    def merge(self, state, other):
        return {v: state.get(v, 0) + other.get(v, 0) for v in {*state, *other}}

    def finalise(self, state):
        n, seen = sum(state.values()), 0
        for value in sorted(state):
            seen += state[value]
            if 2 * seen >= n:
                return value
        return None


class Familiarity(Metric):
    """Mean share of all training clicks that a slate's items have."""

    name, needs = "familiarity", ("item_counts", "n_items")

    def case(self, case):
        return sum(case.counts) / case.n_items


def own_metrics(spark, sf_dir):
    data, recs = two_models(spark, sf_dir)
    counts = P.item_counts(data.train)
    found = E.evaluate(recs, data.truths, (10, 20), ("HitRate", MedianRank(), Familiarity()), item_counts=counts,
                       n_items=counts.agg(F.count(F.lit(1))).scalar())
    return rounded(found, "value")


add("own_metrics_n9_u1", own_metrics, with_recs("""
  , k(top_k) AS (VALUES (10), (20)),
  judged AS (SELECT r.*, k.top_k, (r.case_id, r.item_id) IN (SELECT case_id, item_id FROM truths) AS hit
             FROM recs r JOIN k ON r.rank <= k.top_k WHERE r.case_id IN (SELECT case_id FROM truths)),
  firsts AS (SELECT model, top_k, case_id, min(CASE WHEN hit THEN rank END) AS place, sum(coalesce(c, 0)) AS clicks
             FROM judged LEFT JOIN counts USING (item_id) GROUP BY 1, 2, 3)
  SELECT model, top_k, 'median rank' AS metric, round(quantile_disc(place, 0.5)::DOUBLE, 6) AS value FROM firsts GROUP BY 1, 2
  UNION ALL SELECT model, top_k, 'familiarity', round(avg(clicks / (SELECT count(*) FROM counts)::DOUBLE), 6) FROM firsts GROUP BY 1, 2
  UNION ALL SELECT model, top_k, 'HitRate', round(avg((place IS NOT NULL)::INT), 6) FROM firsts GROUP BY 1, 2"""), *NEED)


add("unique_items_a16", lambda s, d: E.unique_item_count(two_models(s, d)[1], dataset(s, d).truths), f""",{RECS}
  SELECT count(DISTINCT item_id) AS n_items FROM (SELECT item_id FROM recs UNION ALL SELECT item_id FROM truths)""",
    *NEED)


def overlap(spark, sf_dir):
    data, recs = two_models(spark, sf_dir)
    return rounded(E.slate_overlap(recs, data.truths, 20), "common_share", "common_correct_share")


add("slate_overlap_a17", overlap, f""",{RECS},
  r AS (SELECT DISTINCT model, case_id, item_id, (case_id, item_id) IN (SELECT case_id, item_id FROM truths) AS hit
        FROM recs),
  own AS (SELECT model, count(*) AS n, sum(hit::INT) AS h FROM r GROUP BY 1)
  SELECT a.model AS model_1, b.model AS model_2, round(count(*) / any_value(own.n), 6) AS common_share,
         round(sum(a.hit::INT) / nullif(any_value(own.h), 0), 6) AS common_correct_share
  FROM r a JOIN r b ON a.case_id = b.case_id AND a.item_id = b.item_id AND a.model <> b.model
  JOIN own ON own.model = a.model GROUP BY 1, 2""", *NEED)
