"""Queries on session vectors, vector recommendations and reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewright.functions.decay import EMBEDDING_FLOOR, decay_weight
from slatewright.functions.vectors import dot, norm
from slatewright.operators import blocks, clusters, embedding, reduction
from slatewright.operators.embedding import SimilarityOptions, recommend_similar, session_vectors
from slatewright.operators.popularity import item_counts, recommend_popular
from slatewright.plans import workload
from slatewright.plans.prepared import dataset
from slatewright.plans.registry.common import sql
from slatewright.plans.registry.evaluating import rounded
from slatewright.plans.registry.neighbours import DECAY_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, query, text=None, *needs):
    QUERIES[name] = query
    if text is not None:
        SQL[name] = sql(text, *needs)


FLOOR = "0.00001::DOUBLE"


def weight_sql(name):
    return DECAY_SQL[name].format(floor=FLOOR)


DECAYS = ("constant_linear", "scaling_linear", "scaling_quadratic", "scaling_cubic", "log",
          "harmonic", "harmonic_squared")


def decays(spark, sf_dir):
    rows = embedding.with_length(dataset(spark, sf_dir).prompts)
    return rows.select("case_id", "pos", *[
        F.round(decay_weight(d, F.col("pos"), F.col("n"), EMBEDDING_FLOOR), 6).alias(d)
        for d in DECAYS])


add("decays_e5", decays, "SELECT case_id, pos, " + ", ".join(
    f"round({weight_sql(d)}, 6) AS {d}" for d in DECAYS) +
    " FROM (SELECT case_id, pos, max(pos) OVER (PARTITION BY case_id) AS n FROM prompts)", "prompts")


def vectors_query(strategy, decay):
    def run(spark, sf_dir):
        data = dataset(spark, sf_dir, on_vectors=True)
        out = session_vectors(data.prompts, workload.vectors(spark, sf_dir), strategy, decay)
        return out.select("case_id", F.size("vector").alias("dim"), F.round(
            F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6)
            .alias("last"), F.round(norm("vector"), 6).alias("length"))
    return run


PDIM = """
  , pdim AS (SELECT case_id, i, sum({w} * v[i]) / sum({w}) AS x
             FROM vprompts JOIN vecs USING (item_id), range(1, 65) r(i) GROUP BY 1, 2),
  pv AS (SELECT case_id, list(x ORDER BY i) AS x FROM pdim GROUP BY 1)"""
SHOW = """ SELECT case_id, len(x)::INTEGER AS dim, round(x[1], 6) AS first, round(x[-1], 6) AS last,
         round(sqrt(list_inner_product(x, x)), 6) AS length FROM pv"""
NEED = ("vprompts", "vecs")

add("session_vectors_last_e1_e2", vectors_query("last", None), """
  , pv AS (SELECT case_id, v AS x FROM vprompts JOIN vecs USING (item_id) WHERE pos = n)""" + SHOW, *NEED)
add("session_vectors_mean_e3", vectors_query("mean", "harmonic"),
    PDIM.format(w=weight_sql("harmonic")) + SHOW, *NEED)
add("session_vectors_concat_e4", vectors_query("concat", "log"), f"""
  , pv AS (SELECT case_id, flatten(list(list_transform(v, lambda q: q * {weight_sql("log")}) ORDER BY pos)) AS x
           FROM vprompts JOIN vecs USING (item_id) GROUP BY 1)""" + SHOW, *NEED)

SCORE_SQL = {
    "cosine": "list_cosine_similarity(x, v)", "dot": "list_inner_product(x, v)",
    "euclidean": "1 / (1 + sqrt(greatest(list_inner_product(x, x) + list_inner_product(v, v)"
                 " - 2 * list_inner_product(x, v), 0)))",
    "negative_euclidean": "-sqrt(greatest(list_inner_product(x, x) + list_inner_product(v, v)"
                          " - 2 * list_inner_product(x, v), 0))",
}


def similar(options, k=20):
    def run(spark, sf_dir):
        data = dataset(spark, sf_dir, on_vectors=True)
        recs = recommend_similar(data.prompts, workload.vectors(spark, sf_dir), k, options)
        # Scores of prompt items carry the penalty and are not shown.
        return recs.select("case_id", "rank", "item_id", F.when(
            F.col("score") > -1e8, F.col("score")).alias("score"))
    return run


def similar_sql(measure, weight, k=20, seen="- CASE WHEN s.item_id IS NULL THEN 0 ELSE 1e9 END",
                keep="true"):
    return PDIM.format(w=weight) + f""",
  seen AS (SELECT DISTINCT case_id, item_id FROM vprompts),
  scored AS (SELECT pv.case_id, vecs.item_id, s.item_id IS NOT NULL AS is_seen,
                    round({SCORE_SQL[measure]}, 9) {seen} AS score
             FROM pv JOIN vecs ON true LEFT JOIN seen s ON s.case_id = pv.case_id AND s.item_id = vecs.item_id),
  ranked AS (SELECT case_id, item_id, score, row_number() OVER (
               PARTITION BY case_id ORDER BY score DESC, item_id) AS rank FROM scored WHERE {keep})
  SELECT case_id, rank, item_id, CASE WHEN score > -1e8 THEN score END AS score FROM ranked WHERE rank <= {k}"""


for _name, _measure, _decay in (("cosine_e6_e9_e10", "cosine", "harmonic"),
                                ("dot_e7_m13", "dot", "scaling_linear"),
                                ("euclidean_e8", "euclidean", None)):
    add(f"recommend_similar_{_name}", similar(SimilarityOptions(_measure, "mean", _decay)),
        similar_sql(_measure, weight_sql(_decay)), *NEED)
add("recommend_similar_strict_e9", similar(SimilarityOptions(strict=True)),
    similar_sql("cosine", weight_sql("harmonic"), keep="NOT is_seen"), *NEED)
add("recommend_similar_full_order_e10", similar(SimilarityOptions(), -1),
    similar_sql("cosine", weight_sql("harmonic"), k=1_000_000), *NEED)

START_SQL = {"LINEAR": "pos::DOUBLE", "QUADRATIC": "pos::DOUBLE ** 2", "CUBIC": "pos::DOUBLE ** 3",
             "CONSTANT": "1.0::DOUBLE", "LAST_ONLY": "(CASE WHEN pos = n THEN 1.0 ELSE 0.0 END)::DOUBLE"}
for _name, _measure in (("LINEAR", "dot"), ("QUADRATIC", "negative_euclidean"), ("CUBIC", "dot"),
                        ("CONSTANT", "negative_euclidean"), ("LAST_ONLY", "dot")):
    add(f"recommend_start_weights_{_name.lower()}_e12",
        similar(SimilarityOptions(_measure, "mean", None, start_weights=_name)),
        similar_sql(_measure, START_SQL[_name]), *NEED)


def zero_cut(spark, sf_dir):
    """Popularity slates with the score of rare items set to zero, cut at the first zero."""
    data = dataset(spark, sf_dir)
    recs = recommend_popular(data.train, data.case_ids(), 20).withColumn(
        "score", F.when((F.col("item_id") + F.col("case_id")) % 7 == 0, 0.0).otherwise(F.col("score")))
    return embedding.drop_from_first_zero(recs).select("case_id", "rank", "item_id", "score")


add("zero_cut_e11", zero_cut, """
  , r AS (SELECT case_id, rank, popular.item_id, CASE WHEN (popular.item_id + case_id) % 7 = 0 THEN 0.0
            ELSE c END::DOUBLE AS score FROM truths, popular WHERE rank <= 20)
  SELECT case_id, rank, item_id, score FROM r WHERE rank < coalesce((
    SELECT min(rank) FROM r q WHERE q.case_id = r.case_id AND q.score = 0), 1000)""", "truths", "popular")


def cached(spark, sf_dir):
    """Part names through a cache of the names of the largest parts; the embedder counts characters."""
    part = workload.table(spark, sf_dir, "part")
    texts = part.select(F.col("p_name").alias("text"))
    cache = part.where("p_size = 50").select(F.col("p_name").alias("text")).distinct().select(
        "text", F.lit("letters").alias("engine"),
        F.array(F.length("text").cast("double"), F.lit(0.0)).alias("embedding"))
    everything, _ = embedding.cached_embeddings(
        texts, cache, "letters", lambda part: [[len(t), 1.0] for t in part])
    return everything.select("text", F.col("embedding")[0].alias("n"), F.col("embedding")[1].alias("fresh"))


add("embedding_cache_e13_e14", cached, """
  SELECT p_name AS text, length(p_name)::DOUBLE AS n,
         max(CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 50) THEN 0.0 ELSE 1.0 END)::DOUBLE AS fresh
  FROM part GROUP BY 1""")


def word_vectors(spark, sf_dir):
    """Part names averaged over a vocabulary of brand-name words with known vectors."""
    part = workload.table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    vocabulary = words.where(F.length("word") > 3).select("word", F.array(
        F.length("word").cast("double"), F.ascii("word").cast("double")).alias("vector"))
    out = embedding.averaged_word_vectors(part.select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name")), vocabulary)
    return out.select("item_id", F.round(F.col("embedding")[0], 6).alias("x"),
                      F.round(F.col("embedding")[1], 6).alias("y"))


add("averaged_word_vectors_e15", word_vectors, """
  , w AS (SELECT p_partkey AS item_id, unnest(string_split(p_name, ' ')) AS word FROM part)
  SELECT item_id, round(avg(length(word)), 6) AS x, round(avg(ascii(word)), 6) AS y FROM w
  WHERE length(word) > 3 GROUP BY 1""".replace(", w AS", "WITH w AS", 1))

add("recommend_popular_r1", lambda s, d: recommend_popular(
    dataset(s, d).train, dataset(s, d).case_ids(), 20), """
  SELECT 'popular' AS model, case_id, rank, popular.item_id, c::DOUBLE AS score
  FROM truths, popular WHERE rank <= 20""", "truths", "popular")

# --- reduction and clusters ---------------------------------------------------------------


def reduced_summary(method, k):
    def run(spark, sf_dir):
        out = reduction.reduce_embeddings(workload.vectors(spark, sf_dir), method, k)
        return out.select("item_id", F.size("embedding").alias("dim"),
                          F.round(norm("embedding"), 4).alias("length"))
    return run


def full_pca(spark, sf_dir):
    """All axes kept: the projection keeps every distance to the mean."""
    out = reduction.reduce_pca(workload.vectors(spark, sf_dir), 64)
    return out.select("item_id", F.round(norm("embedding"), 6).alias("length"))


add("pca_all_axes_v1", full_pca, """
  , mean AS (SELECT i, avg(v[i]) AS m FROM vecs, range(1, 65) r(i) GROUP BY 1)
  SELECT item_id, round(sqrt(sum((v[i] - m) ** 2)), 6) AS length FROM vecs, mean GROUP BY 1""", "vecs")
add("pca_16_v1", reduced_summary("pca", 16))
add("random_projection_v2", lambda s, d: reduction.reduce_embeddings(workload.vectors(s, d), "random", 16).select(
    "item_id", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1), 6).alias("first"),
    F.round(norm("embedding"), 6).alias("length")), """
  , u AS (SELECT i, j, part, (('0x' || substr(md5('42:' || i || ':' || j || ':' || part), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS x
          FROM range(0, 64) a(i), range(0, 16) b(j), range(0, 2) c(part)),
  entries AS (SELECT a.i, a.j, sqrt(-2 * ln(a.x)) * cos(2 * pi() * b.x) / sqrt(16.0::DOUBLE) AS e
              FROM u a JOIN u b ON a.i = b.i AND a.j = b.j AND a.part = 0 AND b.part = 1),
  shown AS (SELECT item_id, j, sum(v[i + 1] * e) AS x FROM vecs, entries GROUP BY 1, 2)
  SELECT item_id, count(*)::INTEGER AS dim, round(max(CASE WHEN j = 0 THEN x END), 6) AS first, round(sqrt(sum(x * x)), 6) AS length
  FROM shown GROUP BY 1""", "vecs")
add("discriminant_v3", reduced_summary("lda", 16))


def axes_law(method, k, label):
    """Covariance of the reduced vectors' axes within classes (or of all): axis, other, value, and whether the spread
    between classes (or of all) falls from axis to axis."""
    def run(spark, sf_dir):
        rows = reduction.reduce_embeddings(workload.vectors(spark, sf_dir), method, k)
        own = [label] if label else []
        long = rows.select("item_id", *own, F.posexplode("embedding").alias("axis", "x"))
        mean = long.groupBy(*own, "axis").agg(F.avg("x").alias("m"))
        centred = long.join(mean, [*own, "axis"]).select("item_id", "axis", (F.col("x") - F.col("m")).alias("x"))
        other = centred.select("item_id", F.col("axis").alias("other"), F.col("x").alias("y"))
        found = centred.join(other, "item_id").groupBy("axis", "other").agg(F.avg(F.col("x") * F.col("y")).alias("c"))
        return found
    return run


def within_law(spark, sf_dir):
    found = axes_law("lda", 16, "class")(spark, sf_dir)
    return found.select("axis", "other", (F.round("c", 4) + 0.0).alias("within"))


# Discriminant axes have unit spread within classes and no covariance; of ten classes there are nine.
add("discriminant_within_v3", within_law, """
  WITH c AS (SELECT least(16, count(DISTINCT label) - 1) AS k FROM embeddings)
  SELECT a::INTEGER AS axis, b::INTEGER AS other, (a = b)::INT::DOUBLE AS within FROM c, range(0, k) x(a), range(0, k) y(b)""")


def principal_law(spark, sf_dir):
    """Covariances of the first 16 principal axes; each axis spreads no more than the one before."""
    found = axes_law("pca", 16, None)(spark, sf_dir)
    spread = found.where("axis = other").select((F.col("axis") + 1).alias("axis"), F.col("c").alias("before"))
    return found.join(spread, "axis", "left").select(
        "axis", "other", ((F.col("axis") == F.col("other")) | (F.abs("c") < 1e-8)).alias("uncorrelated"),
        ((F.col("axis") != F.col("other")) | F.col("before").isNull() | (F.col("c") <= F.col("before") + 1e-12)).alias("falling"))


add("principal_axes_v1", principal_law, """
  SELECT a::INTEGER AS axis, b::INTEGER AS other, true AS uncorrelated, true AS falling FROM range(0, 16) x(a), range(0, 16) y(b)""")
add("unit_rows_v4_v5", lambda s, d: reduction.normalise_rows(workload.vectors(s, d)).select(
    "item_id", F.round(F.element_at("embedding", 1), 6).alias("first"),
    F.round(dot("embedding", "embedding"), 6).alias("square")), """
  SELECT item_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, 1.0::DOUBLE AS square
  FROM vecs""", "vecs")


def clustered(spark, sf_dir):
    return clusters.cluster_items(workload.vectors(spark, sf_dir), 20)


add("cluster_sizes_v6", lambda s, d: clusters.cluster_sizes(clustered(s, d)[0]))


def cluster_law(spark, sf_dir):
    """All items have one cluster, whose centre is their nearest one."""
    assigned, centres = clustered(spark, sf_dir)
    items = workload.vectors(spark, sf_dir)
    nearest = blocks.nearest(items.select(F.col("item_id").alias("case_id"), F.col("embedding").alias("vector")), centres, 1,
                             "negative_euclidean", item="cluster", embedding="centre")
    near = nearest.select(F.col("case_id").alias("item_id"), F.col("cluster").alias("near"))
    return assigned.join(near, "item_id").agg(
        F.countDistinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("cluster") != F.col("near")).alias("n_far"))


add("cluster_assignment_v6", cluster_law, "SELECT 20::BIGINT AS n_clusters, count(*) AS n_items, 0::BIGINT AS n_far FROM embeddings")


def labelled_clusters(spark, sf_dir):
    """The embedding labels as clusters, part names as names (small parts have none)."""
    assigned = workload.vectors(spark, sf_dir).select("item_id", F.col("class").cast("long").alias("cluster"))
    sizes = workload.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_size")
    names = workload.names(spark, sf_dir).join(sizes, "item_id").withColumn(
        "name", F.when(F.col("p_size") > 10, F.col("name")))
    counts = item_counts(dataset(spark, sf_dir, on_vectors=True).train)
    return clusters.popular_per_cluster(assigned, counts, names)


add("popular_per_cluster_v7", labelled_clusters, """
  SELECT label::BIGINT AS cluster, item_id, c AS count FROM (
    SELECT label, item_id, coalesce(c, 0) AS c, row_number() OVER (
      PARTITION BY label ORDER BY coalesce(c, 0) DESC, item_id) AS rn
    FROM vecs LEFT JOIN vcounts USING (item_id) JOIN part ON p_partkey = item_id
    WHERE p_size > 10) WHERE rn = 1""", "vecs", "vcounts")


def near_centres(spark, sf_dir):
    """Mean vector of each label as a centre."""
    items = workload.vectors(spark, sf_dir)
    centres = session_vectors(items.select(F.col("class").cast("long").alias("cluster"), "item_id",
                                           F.lit(1).alias("pos"), F.lit(1).alias("n")),
                              items, "mean", None, key="cluster").withColumnRenamed("vector", "centre")
    truths = dataset(spark, sf_dir, on_vectors=True).truths
    return clusters.nearest_centres(truths, items, centres, 3)


add("nearest_centres_v8", near_centres, """
  , cd AS (SELECT label, i, avg(v[i]) AS m FROM vecs, range(1, 65) r(i) GROUP BY 1, 2),
  cv AS (SELECT label, list(m ORDER BY i) AS m FROM cd GROUP BY 1),
  near AS (SELECT item_id, cv.label, row_number() OVER (PARTITION BY item_id ORDER BY round(-sqrt(greatest(
     list_inner_product(v, v) + list_inner_product(m, m) - 2 * list_inner_product(v, m), 0)), 9) DESC, cv.label) AS rank
     FROM vecs, cv)
  SELECT case_id, rank, label::BIGINT AS cluster FROM vtruths JOIN near USING (item_id) WHERE rank <= 3""",
    "vecs", "vtruths")
