"""Queries on combined and re-ranked slates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.operators import evaluation as E
from slatewright.operators import hybrids as H
from slatewright.operators import popularity as P
from slatewright.operators import splitting, stats
from slatewright.operators.embedding import SimilarityOptions, recommend_similar
from slatewright.operators.ranking import top_n
from slatewright.plans import search, workload
from slatewright.plans.models import Popular
from slatewright.plans.prepared import dataset
from slatewright.plans.registry.common import sql
from slatewright.plans.registry.embeddings import NEED as VECTOR_NEED
from slatewright.plans.registry.embeddings import SCORE_SQL, PDIM, weight_sql
from slatewright.plans.registry.evaluating import NEED, RECS, rounded, two_models

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, query, text=None, *needs):
    QUERIES[name] = query
    if text is not None:
        SQL[name] = sql(text, *needs)


def pair(spark, sf_dir):
    """Successor slates first, popularity slates second."""
    data, recs = two_models(spark, sf_dir)
    return data, recs.where("model = 'follow'"), recs.where("model = 'popular'")


def ensemble_sql(keep: str, params: str) -> str:
    return f""",{RECS},
  params AS (SELECT unnest([{params}])::DOUBLE AS param),
  both_parts AS (
    SELECT param, case_id, item_id, rank AS place FROM recs r, params WHERE model = 'follow' AND ({keep})
    UNION ALL SELECT param, case_id, item_id, rank + 1000 FROM recs, params WHERE model = 'popular'),
  placed AS (SELECT param, case_id, item_id, min(place) AS place FROM both_parts GROUP BY 1, 2, 3),
  ranked AS (SELECT param, case_id, item_id, row_number() OVER (PARTITION BY param, case_id ORDER BY place) AS rank
             FROM placed)"""


SHOW = " SELECT param, case_id, rank, item_id FROM ranked WHERE rank <= 20"
CONFIDENT = "rank < coalesce((SELECT min(rank) FROM recs q WHERE q.model = 'follow' AND" \
            " q.case_id = r.case_id AND q.score < param), 1000)"


def rank_ensemble(spark, sf_dir):
    _, first, second = pair(spark, sf_dir)
    return H.rank_ensemble(first, second, (2, 5, 10), 20)


add("rank_ensemble_h1", rank_ensemble, ensemble_sql("rank <= param", "2, 5, 10") + SHOW, *NEED)


def confidence_ensemble(spark, sf_dir):
    _, first, second = pair(spark, sf_dir)
    return H.confidence_ensemble(first, second, (2.0, 3.0), 20)


add("confidence_ensemble_h2", confidence_ensemble, ensemble_sql(CONFIDENT, "2, 3") + SHOW, *NEED)


def prefix_lengths(spark, sf_dir):
    return rounded(H.prefix_lengths(pair(spark, sf_dir)[1], (2.0, 3.0)), "mean", "std")


add("confident_prefix_lengths_h2", prefix_lengths, f""",{RECS},
  params AS (SELECT unnest([2, 3])::DOUBLE AS param),
  l AS (SELECT param, case_id, count(*) FILTER (WHERE {CONFIDENT}) AS n
        FROM recs r, params WHERE model = 'follow' GROUP BY 1, 2)
  SELECT param, count(*) AS n_cases, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
         min(n) AS min, max(n) AS max FROM l GROUP BY 1""", *NEED)

POPULARITY = """
  pops AS (SELECT item_id, count(DISTINCT session_id) / (SELECT count(DISTINCT session_id) FROM train) AS p
           FROM train GROUP BY 1),
  cuts AS (SELECT unnest([0.25, 0.75])::DOUBLE AS param, unnest(quantile_cont(p, [0.25, 0.75])) AS cut FROM pops)"""


def _popularity(train):
    popularity = stats.session_popularity(train)
    return popularity, stats.popularity_cutoffs(popularity, (0.25, 0.75))


def popularity_switch(spark, sf_dir):
    data, first, second = pair(spark, sf_dir)
    lengths = data.prompts.groupBy("case_id").agg(F.max("pos").alias("n"))
    last = data.prompts.join(lengths, "case_id").where("pos = n").select("case_id", "item_id")
    return H.popularity_switch(first, second, last, *_popularity(data.train), 20)


add("popularity_switch_h3", popularity_switch, f""",{RECS},{POPULARITY}
  SELECT param, case_id, rank, r.item_id FROM lasts JOIN pops USING (item_id), cuts
  JOIN recs r USING (case_id) WHERE r.model = CASE WHEN p >= cut THEN 'follow' ELSE 'popular' END""".replace(
    "FROM lasts JOIN pops USING (item_id), cuts\n  JOIN recs r USING (case_id) WHERE",
    "FROM (SELECT case_id, param, coalesce(p, 0) >= cut AS hot FROM lasts LEFT JOIN pops USING (item_id), cuts)"
    "\n  JOIN recs r USING (case_id) WHERE").replace("p >= cut THEN", "hot THEN"), *NEED)


def popularity_filter(spark, sf_dir):
    data, first, _ = pair(spark, sf_dir)
    return H.popularity_filter(first, *_popularity(data.train), 10)


FILTERED = """
  low AS (SELECT param, case_id, rank, r.item_id, coalesce(p, 0) < cut AS is_low, count(*) OVER w AS n,
                 sum((coalesce(p, 0) < cut)::INT) OVER (w ORDER BY rank) AS nth
          FROM {recs} r LEFT JOIN {pops} pops ON pops.item_id = r.item_id, cuts
          WINDOW w AS (PARTITION BY param, case_id)),
  kept AS (SELECT param, case_id, item_id, row_number() OVER (PARTITION BY param, case_id ORDER BY rank) AS rank
           FROM low WHERE NOT is_low OR nth > n - {k})"""
add("popularity_filter_h4", popularity_filter, f""",{RECS},{POPULARITY},
  fr AS (SELECT * FROM recs WHERE model = 'follow'),""" + FILTERED.format(recs="fr", pops="pops", k=10) + """
  SELECT param, case_id, rank, item_id FROM kept WHERE rank <= 10""", *NEED)


def vector_slates(spark, sf_dir, k):
    data = dataset(spark, sf_dir, on_vectors=True)
    items = workload.vectors(spark, sf_dir)
    return data, items, recommend_similar(data.prompts, items, k, SimilarityOptions(strict=True))


LEVELS = (0.2, 0.35)

VSLATES = PDIM.format(w=weight_sql("harmonic")) + f""",
  seen AS (SELECT DISTINCT case_id, item_id FROM vprompts),
  vs AS (SELECT case_id, item_id, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, item_id) AS rank FROM (
           SELECT case_id, item_id, round({SCORE_SQL["cosine"]}, 9) AS s FROM pv, vecs)
         WHERE (case_id, item_id) NOT IN (SELECT case_id, item_id FROM seen))"""


def walk_sql(source: str, keys: str, levels: str, k: int) -> str:
    """The greedy walk as recursion over ranks, carrying the kept items."""
    on = " AND ".join(f"w.{c} = s.{c}" for c in keys.split(", "))
    cols = ", ".join(f"w.{c}" for c in keys.split(", "))
    return f"""
  levels AS (SELECT unnest([{levels}])::DOUBLE AS level),
  walk AS (
    SELECT level, {keys}, 1::BIGINT AS step, [item_id] AS kept FROM {source}, levels WHERE rank = 1
    UNION ALL
    SELECT w.level, {cols}, w.step + 1, CASE WHEN len(w.kept) < {k} AND coalesce((
             SELECT max(list_cosine_similarity(a.v, b.v)) FROM vecs b WHERE list_contains(w.kept, b.item_id)), 0)
             < w.level THEN list_append(w.kept, s.item_id) ELSE w.kept END
    FROM walk w JOIN {source} s ON {on} AND s.rank = w.step + 1 JOIN vecs a ON a.item_id = s.item_id),
  final AS (SELECT level, {keys}, arg_max(kept, step) AS kept FROM walk GROUP BY ALL)"""


def recursive(text: str, *needs: str) -> str:
    return sql(text, *needs).replace("WITH ", "WITH RECURSIVE ", 1)


def diversity(spark, sf_dir):
    _, items, slates = vector_slates(spark, sf_dir, 30)
    return H.diversity_filter(slates, items, LEVELS, 10)


QUERIES["diversity_filter_h5"] = diversity
SQL["diversity_filter_h5"] = recursive(
    VSLATES + ", cut30 AS (SELECT * FROM vs WHERE rank <= 30)," + walk_sql("cut30", "case_id", "0.2, 0.35", 10) + """
  SELECT level AS param, case_id, unnest(range(1, len(kept) + 1))::INTEGER AS rank, unnest(kept) AS item_id
  FROM final""", *VECTOR_NEED)


def diversity_sweep(spark, sf_dir):
    """Thresholds at similarity quantiles of the item table, evaluated in one report."""
    data, items, slates = vector_slates(spark, sf_dir, 50)
    levels = stats.similarity_cutoffs(items, (0.9, 0.97))
    out = H.diversity_filter(slates, items, levels, 10).withColumn(
        "model", F.concat_ws("-", F.lit("similar"), F.lit("None"), F.lit("Divers"),
                             F.when(F.col("param") == levels[0], "0.9").otherwise("0.97")))
    return rounded(E.evaluate(out, data.truths, (5, 10), E.RANKING), "value")


QUERIES["diversity_sweep_h6"] = diversity_sweep
SQL["diversity_sweep_h6"] = recursive(
    VSLATES + """,
  lv AS (SELECT quantile_cont(list_cosine_similarity(x.v, y.v), [0.9, 0.97]) AS q
         FROM vecs x JOIN vecs y ON x.item_id <> y.item_id),
  cut50 AS (SELECT * FROM vs WHERE rank <= 50),"""
    + walk_sql("cut50", "case_id", "(SELECT q[1] FROM lv), (SELECT q[2] FROM lv)", 10) + """,
  hit AS (SELECT CASE WHEN level = (SELECT q[1] FROM lv) THEN '0.9' ELSE '0.97' END AS l, top_k,
                 list_position(kept, t.item_id) AS r
          FROM final JOIN vtruths t USING (case_id) CROSS JOIN (VALUES (5), (10)) k(top_k)),
  rep AS (SELECT l, top_k, avg(CASE WHEN r BETWEEN 1 AND top_k THEN 1 / log2(r + 1.0) ELSE 0 END) AS n,
                 avg(CASE WHEN r BETWEEN 1 AND top_k THEN 1.0 ELSE 0 END) AS h,
                 avg(CASE WHEN r BETWEEN 1 AND top_k THEN 1.0 / r ELSE 0 END) AS m FROM hit GROUP BY 1, 2)
  SELECT 'similar-None-Divers-' || l AS model, top_k, unnest(['NDCG', 'HitRate', 'MRR']) AS metric,
         round(unnest([n, h, m]), 6) AS value FROM rep""", "vtruths", *VECTOR_NEED)


def popular_then_diverse(spark, sf_dir):
    data, items, slates = vector_slates(spark, sf_dir, 30)
    return H.popularity_then_diversity(slates, *_popularity(data.train), items, (0.3,), 10)


VPOPS = POPULARITY.replace("FROM train", "FROM vtrain")
QUERIES["popularity_then_diversity_h7"] = popular_then_diverse
SQL["popularity_then_diversity_h7"] = recursive(
    VSLATES + f",{VPOPS}, cut30 AS (SELECT * FROM vs WHERE rank <= 30),"
    + FILTERED.format(recs="cut30", pops="pops", k=10)
    + ", short AS (SELECT * FROM kept WHERE rank <= 10),"
    + walk_sql("short", "param, case_id", "0.3", 10) + """
  SELECT param AS pop_param, level AS div_param, case_id, unnest(range(1, len(kept) + 1))::INTEGER AS rank,
         unnest(kept) AS item_id FROM final""", "vtrain", *VECTOR_NEED)


def rerank_counts(spark, sf_dir):
    data, items, slates = vector_slates(spark, sf_dir, 20)
    return H.rerank_batch(slates, items, 0.35, 10, data.case_ids())[1]


QUERIES["rerank_batch_h8"] = rerank_counts
SQL["rerank_batch_h8"] = recursive(
    VSLATES + ", cut20 AS (SELECT * FROM vs WHERE rank <= 20)," + walk_sql("cut20", "case_id", "0.35", 10) + """,
  old AS (SELECT case_id, list(item_id ORDER BY rank) AS o FROM cut20 WHERE rank <= 10 GROUP BY 1)
  SELECT count(*) AS n_cases, 0::BIGINT AS n_empty, count_if(o = kept)::BIGINT AS n_unchanged
  FROM final JOIN old USING (case_id)""", *VECTOR_NEED)


def pair_overview(spark, sf_dir):
    """Share of equal first choices for every unordered pair of models."""
    data, recs = two_models(spark, sf_dir)
    third = recs.where("model = 'popular'").withColumn("model", F.lit("reverse")).withColumn(
        "rank", F.lit(21) - F.col("rank"))
    firsts = recs.unionByName(third).where("rank = 1").groupBy("case_id").pivot(
        "model", ["follow", "popular", "reverse"]).agg(F.first("item_id"))
    rows = [F.struct(F.lit(a).alias("model_1"), F.lit(b).alias("model_2"),
                     (F.col(a) == F.col(b)).alias("same"))
            for a, b in H.model_pairs(["popular", "follow", "reverse"])]
    return firsts.select(F.inline(F.array(*rows))).groupBy("model_1", "model_2").agg(
        F.count_if("same").alias("n_same"))


add("model_pairs_h9", pair_overview, f""",{RECS},
  three AS (SELECT * FROM recs UNION ALL SELECT 'reverse', case_id, 21 - rank, item_id, score
            FROM recs WHERE model = 'popular'),
  f AS (SELECT * FROM three WHERE rank = 1)
  SELECT a.model AS model_1, b.model AS model_2, count_if(a.item_id = b.item_id)::BIGINT AS n_same
  FROM f a JOIN f b ON a.case_id = b.case_id AND a.model < b.model GROUP BY 1, 2""", *NEED)


def sweep_reports(spark, sf_dir):
    """Reports of the rank ensemble per cut-off; two halves of the cases stand for folds."""
    data, first, second = pair(spark, sf_dir)
    slates = H.rank_ensemble(first, second, (2, 5, 10), 20)
    folds = slates.withColumn("fold", (F.col("case_id") % 2).cast("int")).withColumn(
        "model", F.lit("follow-popular"))
    return E.evaluate(folds, data.truths, (10, 20), E.RANKING, keys=("model", "param", "fold"))


SWEEP = ensemble_sql("rank <= param", "2, 5, 10") + """,
  hit AS (SELECT param, t.case_id, t.case_id % 2 AS fold, max(CASE WHEN r.item_id = t.item_id THEN rank END) AS r
          FROM truths t JOIN ranked r USING (case_id) WHERE rank <= 20 GROUP BY 1, 2, 3),
  rep AS (SELECT param, fold, top_k, avg(CASE WHEN r <= top_k THEN 1 / log2(r + 1.0) ELSE 0 END) AS ndcg,
                 avg((coalesce(r, 99) <= top_k)::INT) AS hr, avg(CASE WHEN r <= top_k THEN 1.0 / r ELSE 0 END) AS mrr
          FROM hit CROSS JOIN (VALUES (10), (20)) k(top_k) GROUP BY 1, 2, 3)"""

add("best_parameter_h10", lambda s, d: rounded(H.best_parameters(sweep_reports(s, d)), "value"), SWEEP + """
  SELECT 'follow-popular' AS model, arg_max(param, v) AS param, round(max(v), 6) AS value FROM (
    SELECT param, round(avg(ndcg), 12) AS v FROM rep WHERE top_k = 20 GROUP BY 1 ORDER BY param)""", *NEED)

add("several_k_h11", lambda s, d: rounded(sweep_reports(s, d), "value"), SWEEP + """
  SELECT 'follow-popular' AS model, param, fold::INTEGER AS fold, top_k, metric, round(value, 6) AS value FROM (
    SELECT param, fold, top_k, 'NDCG' AS metric, ndcg AS value FROM rep UNION ALL
    SELECT param, fold, top_k, 'HitRate', hr FROM rep UNION ALL SELECT param, fold, top_k, 'MRR', mrr FROM rep)""",
    *NEED)


def results_table(spark, sf_dir):
    reports = E.average_reports(sweep_reports(spark, sf_dir), ("model", "param", "top_k", "metric"))
    named = rounded(reports, "value").withColumn("model", F.concat_ws(
        "-", "model", F.lit("Rank"), F.col("param").cast("int").cast("string"))).drop("param")
    return H.format_results(named, E.RANKING)


add("results_table_h12", results_table, SWEEP + ", m AS (SELECT param, top_k, avg(ndcg) AS n, avg(hr) AS h,"
    " avg(mrr) AS m FROM rep GROUP BY 1, 2) SELECT 'follow' AS model_1, 'popular' AS model_2, 'Rank' AS method,"
    " param::INTEGER::VARCHAR AS param, " + ", ".join(
        f"max(CASE WHEN top_k = {k} THEN round({c}, 6) END) AS \"{m}@{k}\""
        for k in (10, 20) for m, c in (("NDCG", "n"), ("HitRate", "h"), ("MRR", "m"))) + " FROM m GROUP BY 4", *NEED)


@dataclass(frozen=True)
class Followers:
    """Most frequent direct successors of the last prompt item."""

    votes: DataFrame | None = None

    def fit(self, train, items=None):
        here = train.select("session_id", "pos", "item_id")
        there = train.select("session_id", (F.col("pos") - 1).alias("pos"), F.col("item_id").alias("next_item"))
        pairs = here.join(there, ["session_id", "pos"]).groupBy("item_id", "next_item").agg(F.count(F.lit(1)).alias("votes"))
        return Followers(pairs)

    def recommend(self, prompts, k):
        last = prompts.groupBy("case_id").agg(F.max_by("item_id", "pos").alias("item_id"))
        best = top_n(self.votes, ["item_id"], [F.desc("votes"), F.col("next_item")], k)
        return last.join(best, "item_id").select(F.lit("follow").alias("model"), "case_id", "rank", F.col("next_item").alias("item_id"),
                                                 F.col("votes").cast("double").alias("score"))


def searched(spark, sf_dir):
    data = dataset(spark, sf_dir)
    folds = splitting.forward_chaining_folds(data.train, 2)
    prop = search.PopularItems.of(data.train, (0.25, 0.5, 0.75))
    return search.property_search({"popular": Popular(), "follow": Followers()}, data, folds, prop)


# Fold 0 stands for all training sessions and the test sessions.
SEARCH = """
  , bins AS (SELECT session_id, ntile(3) OVER (ORDER BY max_ts, session_id) AS bin
             FROM (SELECT session_id, max(ts) AS max_ts FROM train GROUP BY 1)),
  ftrain AS (SELECT fold, session_id, pos, item_id FROM train JOIN bins USING (session_id), range(1, 3) f(fold) WHERE bin <= fold
             UNION ALL SELECT 0, session_id, pos, item_id FROM train),
  fheld AS (SELECT fold, session_id, row_number() OVER (PARTITION BY fold, session_id ORDER BY pos) AS pos, item_id, m AS n
            FROM (SELECT fold, session_id, pos, item_id, count(*) OVER (PARTITION BY fold, session_id) AS m
                  FROM train JOIN bins USING (session_id), range(1, 3) f(fold)
                  WHERE bin = fold + 1 AND (fold, item_id) IN (SELECT fold, item_id FROM ftrain)) WHERE m >= 2
            UNION ALL SELECT 0, session_id, pos, item_id, n FROM test),
  ftruths AS (SELECT fold, session_id AS case_id, item_id FROM fheld WHERE pos = n),
  fpop AS (SELECT fold, item_id, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, item_id) AS rank FROM ftrain GROUP BY 1, 2),
  fnext AS (SELECT fold, item_id, next_item, row_number() OVER (PARTITION BY fold, item_id ORDER BY count(*) DESC, next_item) AS rank
            FROM (SELECT fold, item_id, lead(item_id) OVER (PARTITION BY fold, session_id ORDER BY pos) AS next_item FROM ftrain)
            WHERE next_item IS NOT NULL GROUP BY 1, 2, 3),
  flast AS (SELECT fold, session_id AS case_id, arg_max(item_id, pos) AS item_id FROM fheld WHERE pos < n GROUP BY 1, 2),
  pools AS (SELECT 'popular' AS model, fold, case_id, rank, fpop.item_id FROM ftruths JOIN fpop USING (fold) WHERE rank <= 100
            UNION ALL SELECT 'follow', fold, case_id, rank, next_item FROM flast JOIN fnext USING (fold, item_id) WHERE rank <= 100),
  pops AS (SELECT item_id, count(DISTINCT session_id) / (SELECT count(DISTINCT session_id) FROM train) AS p FROM train GROUP BY 1),
  cuts AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS param, unnest(quantile_cont(p, [0.25, 0.5, 0.75])) AS cut FROM pops),
  low AS (SELECT model, fold, param, case_id, rank, r.item_id, coalesce(p, 0) < cut AS is_low, count(*) OVER w AS n,
                 sum((coalesce(p, 0) < cut)::INT) OVER (w ORDER BY rank) AS nth
          FROM pools r LEFT JOIN pops USING (item_id), cuts WINDOW w AS (PARTITION BY model, fold, param, case_id)),
  kept AS (SELECT model, fold, param, case_id, item_id, row_number() OVER (PARTITION BY model, fold, param, case_id ORDER BY rank) AS r
           FROM low WHERE NOT is_low OR nth > n - 20),
  hits AS (SELECT k.model, k.fold, k.param, k.case_id, min(CASE WHEN t.item_id = k.item_id THEN r END) AS r
           FROM kept k JOIN ftruths t USING (fold, case_id) WHERE r <= 20 GROUP BY 1, 2, 3, 4),
  rep AS (SELECT model, fold, param, top_k, avg(CASE WHEN r <= top_k THEN 1 / log2(r + 1.0) ELSE 0 END) AS ndcg,
                 avg((coalesce(r, 99) <= top_k)::INT) AS hr, avg(CASE WHEN r <= top_k THEN 1.0 / r ELSE 0 END) AS mrr
          FROM hits CROSS JOIN (VALUES (10), (20)) k(top_k) GROUP BY 1, 2, 3, 4)"""

add("property_search_folds_h10", lambda s, d: rounded(searched(s, d)[0], "value"), SEARCH + """
  SELECT model, param, fold::INTEGER AS fold, top_k, unnest(['NDCG', 'HitRate', 'MRR']) AS metric, round(unnest([ndcg, hr, mrr]), 6) AS value
  FROM rep WHERE fold > 0""", "train", "test")
add("property_search_test_h10", lambda s, d: rounded(searched(s, d)[2], "value"), SEARCH + """,
  best AS (SELECT model, param FROM (SELECT model, param, avg(ndcg) AS v FROM rep WHERE fold > 0 AND top_k = 20 GROUP BY 1, 2)
           ORDER BY v DESC, model, param LIMIT 1)
  SELECT model, param, top_k, unnest(['NDCG', 'HitRate', 'MRR']) AS metric, round(unnest([ndcg, hr, mrr]), 6) AS value
  FROM rep JOIN best USING (model, param) WHERE fold = 0""", "train", "test")
