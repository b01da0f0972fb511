"""Queries on session neighbours, each variant against one SQL template."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from slatewright.functions.decay import decay_weight
from slatewright.functions.similarity import MEASURES, measure
from slatewright.operators import neighbours as N
from slatewright.plans import workload
from slatewright.plans.prepared import dataset
from slatewright.plans.registry.common import sql
from slatewright.plans.registry.evaluating import rounded
from slatewright.session import ensure_checkpoint_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}

SMALL = N.NeighbourOptions(k=20, sample_size=50)


_fitted: dict[tuple, N.NeighbourIndex] = {}


def fitted(spark, sf_dir, on_vectors=False) -> N.NeighbourIndex:
    """The index of the training log, fitted once per application and read from its tables."""
    key = (spark.sparkContext.applicationId, sf_dir, on_vectors)
    if key not in _fitted:
        path = f"{ensure_checkpoint_dir(spark)}/prepared/{key[0]}/neighbours-{uuid.uuid4().hex}"
        _fitted[key] = N.NeighbourIndex.fit(dataset(spark, sf_dir, on_vectors).train, path)
    return _fitted[key]


def _inputs(spark, sf_dir, options, on_vectors=False):
    index = fitted(spark, sf_dir, on_vectors)
    prompts = dataset(spark, sf_dir, on_vectors).prompts
    return index, N.prompt_vectors(N.normalised_prompts(prompts, index.items, options.last_n_items), options.decay)


# --- SQL template -----------------------------------------------------------------------

DECAY_SQL = {
    None: "1.0::DOUBLE",
    "constant_linear": "greatest({floor}, 1.0::DOUBLE - (n - pos) * 0.1::DOUBLE)",
    "scaling_linear": "greatest({floor}, 1.0::DOUBLE - (n - pos) * (1.0::DOUBLE / n))",
    "scaling_quadratic": "greatest({floor}, 1.0::DOUBLE - (n - pos) * (1.0::DOUBLE / n)) ** 2",
    "scaling_cubic": "greatest({floor}, 1.0::DOUBLE - (n - pos) * (1.0::DOUBLE / n)) ** 3",
    "log": "1.0::DOUBLE / (ln((n - pos + 1)::DOUBLE) + 1)",
    "harmonic": "1.0::DOUBLE / (n - pos + 1)",
    "harmonic_squared": "1.0::DOUBLE / ((n - pos + 1)::DOUBLE * (n - pos + 1))",
}
FLOOR = "0.0001::DOUBLE"

MEASURE_SQL = {
    "jaccard": "a / nullif(a + b + c, 0)",
    "stiles": "CASE WHEN n_all * (abs(a*d - b*c) - n_all/2) * (abs(a*d - b*c) - n_all/2) "
              "/ nullif((a+b)*(a+c)*(b+d)*(c+d), 0) > 0 THEN log10(n_all * (abs(a*d - b*c) - n_all/2) "
              "* (abs(a*d - b*c) - n_all/2) / nullif((a+b)*(a+c)*(b+d)*(c+d), 0)) END",
    "anderberg": "((greatest(a,b) + greatest(c,d) + greatest(a,c) + greatest(b,d)) "
                 "- (greatest(a+c,b+d) + greatest(a+b,c+d))) / (2 * n_all)",
    "ample": "coalesce(abs(a*(c+d) / nullif(c*(a+b), 0)), 0)",
    "peirce": "coalesce((a*b + b*c) / nullif(a*b + 2*b*c + c*d, 0), 0)",
    "yule_w": "(sqrt(a*d) - sqrt(b*c)) / nullif(sqrt(a*d) + sqrt(b*c), 0)",
    "tarantula": "coalesce(a*(c+d) / nullif(c*(a+b), 0), 0)",
    "simpson": "a / nullif(least(a+b, a+c), 0)",
    "eyraud": "n_all*n_all*(n_all*a - (a+b)*(a+c)) / nullif((a+b)*(a+c)*(b+d)*(c+d), 0)",
    "fager_mcgowan": "a / nullif(sqrt((a+b)*(a+c)), 0) - greatest(a+b, a+c) / 2",
    "driver_kroeber": "(a/2) * (1/nullif(a+b, 0) + 1/nullif(a+c, 0))",
}

ORDER_SQL = {
    "random": "draw NULLS LAST, md5('42:' || case_id || ':' || session_id), session_id",
    "recent": "s_end DESC, session_id DESC",
    "idf": "idf_sum DESC, session_id",
    "idf_greedy": "best, best_item, draw NULLS LAST, md5('42:' || case_id || ':' || session_id), session_id",
}


def draws(o: N.NeighbourOptions) -> str:
    """CTE ``drawn`` (case_id, session_id, draw) of the cases whose lists are drawn from."""
    n, at_most = o.sample_size, o.draw_factor * o.sample_size
    listed = "SELECT case_id, item_id, df FROM nprompt JOIN idf USING (item_id)"
    spans = {
        "random": f"""SELECT case_id, item_id, df, sum(df) OVER (PARTITION BY case_id ORDER BY item_id) - df AS lo,
               sum(df) OVER (PARTITION BY case_id) AS total FROM ({listed}) QUALIFY total > {at_most}""",
        "idf_greedy": f"""SELECT case_id, item_id, df, 0 AS lo, df AS total FROM ({listed}) WHERE df > {at_most}
               QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY df, item_id) = 1""",
    }.get(o.sampling)
    if spans is None:
        return "drawn AS (SELECT NULL::BIGINT AS case_id, NULL::BIGINT AS session_id, NULL::BIGINT AS draw WHERE false)"
    return f"""spans AS ({spans}),
  lists AS (SELECT item_id, session_id, row_number() OVER (PARTITION BY item_id ORDER BY s_end DESC, session_id DESC) AS number
            FROM cells JOIN send USING (session_id)),
  points AS (SELECT case_id, j, floor(('0x' || substr(md5('42:' || case_id || ':' || j), 1, 13))::BIGINT
                                      / 4503599627370496.0::DOUBLE * total)::BIGINT AS x
             FROM (SELECT case_id, total, unnest(range(0, ({2 * n} * (2 ** ceil(log2(total / {2.0 * n} + 1)) - 1))::BIGINT)) AS j
                   FROM (SELECT DISTINCT case_id, total FROM spans))),
  drawn AS (SELECT case_id, session_id, min(j) AS draw
            FROM points JOIN spans USING (case_id) JOIN lists ON lists.item_id = spans.item_id AND number = x - lo + 1
            JOIN pairs USING (case_id, session_id) WHERE x >= lo AND x < lo + df AND bst.i = spans.item_id GROUP BY 1, 2)"""


def chain(o: N.NeighbourOptions, train="train", prompts="prompts") -> str:
    """CTEs up to ``recs`` for the item-overlap variants."""
    last = "" if o.last_n_items is None else (
        f" WHERE pos > (SELECT max(pos) FROM {prompts} q WHERE q.case_id = p.case_id) - {o.last_n_items}")
    decay = DECAY_SQL[o.decay].format(floor=FLOOR)
    sim = {"dot": "dot", "cosine": "dot / (p_norm * s_norm)"}.get(o.similarity)
    if sim is None:
        sim = MEASURE_SQL[o.similarity]
    vote = "sim * last_pos / n" if o.sequential_weighting else "sim"
    anti = (" WHERE (v.case_id, c.item_id) NOT IN (SELECT case_id, item_id FROM nprompt)"
            if o.filter_prompt_items else "")
    score = "round(sum(vote) * any_value(idf), 9)" if o.idf_weighting else "round(sum(vote), 9)"
    keep = ("WHERE (last_item, item_id) IN (SELECT item_id, next_item FROM follow)"
            if o.sequential_filter else "")
    return f"""
  cells AS (SELECT session_id, item_id, sum(reward::BIGINT)::DOUBLE AS w FROM {train} GROUP BY 1, 2),
  sess AS (SELECT session_id, sqrt(sum(w * w)) AS s_norm, count(*) AS s_size FROM cells GROUP BY 1),
  send AS (SELECT session_id, max(ts) AS s_end FROM {train} GROUP BY 1),
  idf AS (SELECT item_id, count(*) AS df,
                 1 + ln((SELECT count(DISTINCT session_id) FROM {train})::DOUBLE / count(*)) AS idf
          FROM cells GROUP BY 1),
  follow AS (SELECT DISTINCT item_id, next_item FROM (
      SELECT item_id, lead(item_id) OVER (PARTITION BY session_id ORDER BY pos) AS next_item
      FROM {train}) WHERE next_item IS NOT NULL),
  firsts AS (SELECT case_id, item_id, min(pos) AS pos FROM {prompts} p{last} GROUP BY 1, 2),
  nprompt AS (SELECT case_id, item_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS pos,
                     count(*) OVER (PARTITION BY case_id) AS n
              FROM firsts WHERE item_id IN (SELECT item_id FROM {train})),
  pvec AS (SELECT *, {decay} AS pw FROM nprompt),
  pnorm AS (SELECT case_id, sqrt(sum(pw * pw)) AS p_norm, any_value(n) AS n,
                   max(CASE WHEN pos = n THEN item_id END) AS last_item FROM pvec GROUP BY 1),
  pairs AS (
    SELECT case_id, session_id, count(*) AS n_both, sum(pw * w) AS dot, round(sum(idf), 9) AS idf_sum,
           max(pos) AS last_pos, min(struct_pack(c := round(-idf, 9), i := item_id)) AS bst
    FROM pvec JOIN cells USING (item_id) JOIN idf USING (item_id) GROUP BY 1, 2),
  {draws(o)},
  described AS (
    SELECT pairs.*, bst.c AS best, bst.i AS best_item, n, p_norm, last_item, s_norm, s_size, s_end, draw
    FROM pairs JOIN pnorm USING (case_id) JOIN sess USING (session_id) JOIN send USING (session_id)
    LEFT JOIN drawn USING (case_id, session_id)),
  sampled AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {ORDER_SQL[o.sampling]}) AS sample_rank
      FROM described) WHERE sample_rank <= {o.sample_size}),
  counted AS (SELECT *, n_both::DOUBLE AS a, (n - n_both)::DOUBLE AS b, (s_size - n_both)::DOUBLE AS c,
                     (n_all - n - s_size + n_both)::DOUBLE AS d
              FROM (SELECT *, (SELECT count(*) FROM idf)::DOUBLE AS n_all FROM sampled)),
  alike AS (SELECT *, round({sim}, 9) AS sim FROM counted),
  near AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sim DESC NULLS LAST, session_id) AS sim_rank
      FROM alike) WHERE sim_rank <= {o.k}),
  votes AS (SELECT case_id, session_id, last_item, coalesce({vote}, 0) AS vote FROM near),
  scores AS (SELECT v.case_id, c.item_id, any_value(last_item) AS last_item, {score} AS score
             FROM votes v JOIN cells c USING (session_id) JOIN idf USING (item_id){anti} GROUP BY 1, 2),
  ranked AS (SELECT case_id, item_id, score,
                    row_number() OVER (PARTITION BY case_id ORDER BY score DESC, item_id) AS rank
             FROM scores {keep})"""


def template(o: N.NeighbourOptions, body: str) -> str:
    return sql("," + chain(o) + "\n" + body, "train", "prompts")


# --- steps ------------------------------------------------------------------------------

def weights_query(spark, sf_dir):
    return N.session_item_weights(dataset(spark, sf_dir).train)


QUERIES["session_item_weights_k1"] = weights_query
SQL["session_item_weights_k1"] = template(SMALL, "SELECT session_id, item_id, w FROM cells")


def normalised_query(spark, sf_dir):
    return N.normalised_prompts(dataset(spark, sf_dir).prompts, fitted(spark, sf_dir).items, 12)


QUERIES["normalised_prompts_k2"] = normalised_query
SQL["normalised_prompts_k2"] = template(
    replace(SMALL, last_n_items=12), "SELECT case_id, item_id, pos, n FROM nprompt")


def candidates_query(spark, sf_dir):
    index, prompt_items = _inputs(spark, sf_dir, SMALL)
    # shuffled once, by case; both counts are made there
    met = prompt_items.select("case_id", "item_id").join(index.postings.select("item_id", "session_id"), "item_id")
    pairs = met.select("case_id", "session_id").repartition("case_id").groupBy("case_id", "session_id").agg(
        F.count(F.lit(1)).alias("n_both"))
    return pairs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_sessions"),
                                        F.sum("n_both").alias("n_shared"))


QUERIES["candidate_sessions_k3"] = candidates_query
SQL["candidate_sessions_k3"] = template(
    SMALL, "SELECT case_id, count(*) AS n_sessions, sum(n_both)::BIGINT AS n_shared FROM pairs GROUP BY 1")


def _sample(options):
    def run(spark, sf_dir):
        index, prompt_items = _inputs(spark, sf_dir, options)
        return N.sampled_pairs(prompt_items, index, options).select(
            "case_id", "sample_rank", "session_id")
    return run


for _name, _sampling in (("random_k4", "random"), ("recent_k5", "recent"), ("idf_k6", "idf"),
                         ("idf_greedy_k7", "idf_greedy")):
    _o = replace(SMALL, sampling=_sampling)
    QUERIES[f"neighbour_sample_{_name}"] = _sample(_o)
    SQL[f"neighbour_sample_{_name}"] = template(
        _o, "SELECT case_id, sample_rank, session_id FROM sampled")

# The dispatch by name with items above a low frequency bound treated as hot: the samples are as large as the others.
for _sampling in N.SAMPLINGS:
    _o = replace(SMALL, sampling=_sampling, hot_df=40)
    QUERIES[f"neighbour_sample_hot_{_sampling}_k8"] = _sample(_o)
    SQL[f"neighbour_sample_hot_{_sampling}_k8"] = template(
        _o, "SELECT case_id, sample_rank, session_id FROM sampled")


def idf_query(spark, sf_dir):
    return rounded(N.inverse_frequency(N.session_item_weights(dataset(spark, sf_dir).train)), "idf")


QUERIES["inverse_frequency_k9"] = idf_query
SQL["inverse_frequency_k9"] = template(SMALL, "SELECT item_id, df, round(idf, 6) AS idf FROM idf")

DECAYS = ("constant_linear", "log", "harmonic", "harmonic_squared")


def decay_query(spark, sf_dir):
    rows = N.normalised_prompts(dataset(spark, sf_dir).prompts, fitted(spark, sf_dir).items)
    return rows.select("case_id", "pos", *[
        F.round(decay_weight(d, F.col("pos"), F.col("n"), N.NEIGHBOUR_FLOOR), 6).alias(d)
        for d in DECAYS])


QUERIES["position_decays_k10"] = decay_query
SQL["position_decays_k10"] = template(SMALL, "SELECT case_id, pos, " + ", ".join(
    f"round({DECAY_SQL[d].format(floor=FLOOR)}, 6) AS {d}" for d in DECAYS) + " FROM nprompt")


def prompt_vector_query(spark, sf_dir):
    prompt_items = _inputs(spark, sf_dir, replace(SMALL, decay="linear"))[1]
    return rounded(prompt_items.select("case_id", "item_id", "pw", "p_norm"), "pw", "p_norm")


QUERIES["prompt_vectors_k11"] = prompt_vector_query
SQL["prompt_vectors_k11"] = template(
    replace(SMALL, decay="constant_linear"),
    "SELECT case_id, item_id, round(pw, 6) AS pw, round(p_norm, 6) AS p_norm"
    " FROM pvec JOIN pnorm USING (case_id)")

SIM = replace(SMALL, decay="harmonic")


def similarity_query(spark, sf_dir):
    index, prompt_items = _inputs(spark, sf_dir, SIM)
    pairs = N.sampled_pairs(prompt_items, index, SIM)
    cosine = N.item_similarity(pairs, "cosine", None).select(
        "case_id", "session_id", "dot", F.col("sim").alias("cosine"))
    return rounded(cosine, "dot")


QUERIES["overlap_similarity_k12"] = similarity_query
SQL["overlap_similarity_k12"] = template(
    SIM, "SELECT case_id, session_id, round(dot, 6) AS dot, sim AS cosine FROM alike")


def measures_query(spark, sf_dir):
    index, prompt_items = _inputs(spark, sf_dir, SMALL)
    n_items = index.items.agg(F.count(F.lit(1))).scalar()
    pairs = N.sampled_pairs(prompt_items, index, SMALL)
    return pairs.select("case_id", "session_id", *[
        F.round(measure(m, F.col("both"), F.col("s_size"), F.col("n"), n_items), 6).alias(m)
        for m in MEASURES])


QUERIES["set_similarities_k13_m1_m11"] = measures_query
SQL["set_similarities_k13_m1_m11"] = template(SMALL, "SELECT case_id, session_id, " + ", ".join(
    f"round({MEASURE_SQL[m]}, 6) AS {m}" for m in MEASURES) + " FROM counted")


def nearest_query(spark, sf_dir):
    index, prompt_items = _inputs(spark, sf_dir, SIM)
    pairs = N.item_similarity(N.sampled_pairs(prompt_items, index, SIM), "cosine", None)
    close = N.sequential_weight(N.nearest_sessions(pairs, SIM.k))
    return rounded(close.select("case_id", "sim_rank", "session_id", "sim", "seq"), "seq")


QUERIES["nearest_sessions_k14_k16"] = nearest_query
SQL["nearest_sessions_k14_k16"] = template(
    SIM, "SELECT case_id, sim_rank, session_id, sim,"
         " round(last_pos / n, 6) AS seq FROM near")


def candidate_items_query(spark, sf_dir):
    index, prompt_items = _inputs(spark, sf_dir, SIM)
    pairs = N.item_similarity(N.sampled_pairs(prompt_items, index, SIM), "cosine", None)
    close = N.nearest_sessions(pairs, SIM.k)
    return N.scored_candidates(close, index.cells, prompt_items, index.items, SIM).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        # summed as decimals, so that the order of summing does not matter
        F.round(F.sum(F.round("score", 12).cast("decimal(28,12)")), 6).cast("double").alias("total"))


QUERIES["candidate_items_k15_k19"] = candidate_items_query
SQL["candidate_items_k15_k19"] = template(
    SIM, "SELECT case_id, count(*) AS n_items,"
         " round(sum(round(score, 12)::DECIMAL(28, 12)), 6)::DOUBLE AS total FROM scores GROUP BY 1")


def successors_query(spark, sf_dir):
    return N.successors(dataset(spark, sf_dir).train)


QUERIES["successors_k17"] = successors_query
SQL["successors_k17"] = template(SMALL, "SELECT item_id, next_item FROM follow")

VARIANTS = {
    "sknn": N.NeighbourOptions(),
    "sknn_recent": N.NeighbourOptions(sampling="recent"),
    "sknn_jaccard": N.NeighbourOptions(similarity="jaccard"),
    "sknn_keep_prompt_items": N.NeighbourOptions(filter_prompt_items=False),
    "vsknn": N.NeighbourOptions(decay="harmonic", similarity="dot", sample_size=600, k=200),
    "vsknn_idf": N.NeighbourOptions(decay="linear", similarity="cosine", sampling="idf_greedy",
                                    idf_weighting=True),
    "vsknn_last_items": N.NeighbourOptions(decay="quadratic", last_n_items=10, sampling="idf"),
    "ssknn": N.NeighbourOptions(sequential_weighting=True, similarity="dot"),
    "sfsknn": N.NeighbourOptions(sequential_filter=True, decay="log"),
    "vsknn_hot_items": N.NeighbourOptions(decay="harmonic", sampling="idf", hot_df=45),
}


def _recommend(options):
    def run(spark, sf_dir):
        data = dataset(spark, sf_dir)
        return N.recommend_neighbours(data.prompts, fitted(spark, sf_dir), 20, options)
    return run


for _name, _o in VARIANTS.items():
    _sql_o = replace(_o, decay={"linear": "constant_linear", "quadratic": "harmonic_squared"}.get(
        _o.decay, _o.decay))
    QUERIES[f"recommend_{_name}_k20_k25_k26"] = _recommend(_o)
    SQL[f"recommend_{_name}_k20_k25_k26"] = template(
        _sql_o, f"SELECT '{_o.model_name()}' AS model, case_id, rank, item_id,"
                " score FROM ranked WHERE rank <= 20")


def sequential_filter_query(spark, sf_dir):
    index, prompt_items = _inputs(spark, sf_dir, SIM)
    pairs = N.item_similarity(N.sampled_pairs(prompt_items, index, SIM), "cosine", None)
    scores = N.scored_candidates(N.nearest_sessions(pairs, SIM.k), index.cells, prompt_items, index.items, SIM, index.follow)
    return scores.select("case_id", "item_id")


QUERIES["sequential_filter_k18"] = sequential_filter_query
SQL["sequential_filter_k18"] = template(
    replace(SIM, sequential_filter=True), "SELECT case_id, item_id FROM ranked")


def single_prompt_query(spark, sf_dir):
    """The longest prompt of the split, recommended on its own from the whole log."""
    data = dataset(spark, sf_dir)
    longest = data.prompts.orderBy(F.desc("pos"), "case_id").select("case_id").limit(1)
    prompt = data.prompts.join(F.broadcast(longest), "case_id")  # one row
    return N.recommend_one(prompt, fitted(spark, sf_dir), 20).drop("model", "case_id")


QUERIES["recommend_one_prompt_k24"] = single_prompt_query
SQL["recommend_one_prompt_k24"] = template(
    N.NeighbourOptions(),
    "SELECT rank, item_id, score FROM ranked WHERE rank <= 20 AND case_id ="
    " (SELECT case_id FROM prompts ORDER BY pos DESC, case_id LIMIT 1)")



def masked_query(spark, sf_dir):
    """All prompts, with every third item allowed to be shown."""
    index = fitted(spark, sf_dir)
    allowed = index.items.where("item_id % 3 = 0").select("item_id")
    return N.recommend_neighbours(dataset(spark, sf_dir).prompts, index, 10, N.NeighbourOptions(), allowed=allowed).drop("model")


QUERIES["recommend_masked_k24"] = masked_query
SQL["recommend_masked_k24"] = template(N.NeighbourOptions(), """
  SELECT case_id, r AS rank, item_id, score FROM (
    SELECT case_id, item_id, score, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS r FROM ranked WHERE item_id % 3 = 0)
  WHERE r <= 10""")

# --- vectors ----------------------------------------------------------------------------

EMB = N.NeighbourOptions(use_item_embeddings=True, prompt_strategy="mean", train_strategy="mean",
                         decay="harmonic", sample_size=200, k=50)
EMB_LAST = replace(EMB, prompt_strategy="last", train_strategy="last", decay=None,
                   similarity="dot")
EMB_CONCAT = replace(EMB, prompt_strategy="concat", train_strategy="concat", sample_size=40, k=20)


def _recommend_vectors(options):
    def run(spark, sf_dir):
        data = dataset(spark, sf_dir, on_vectors=True)
        return N.recommend_neighbours(data.prompts, fitted(spark, sf_dir, on_vectors=True), 20, options,
                                      workload.vectors(spark, sf_dir))
    return run


def vector_template(o: N.NeighbourOptions, similar: str, more: str) -> str:
    text = chain(o, "vtrain", "vp")
    head, rest = text.split("  alike AS (", 1)
    tail = rest.split("\n", 1)[1]
    body = ("SELECT 'SKNN_EMB' AS model, case_id, rank, item_id, score"
            " FROM ranked WHERE rank <= 20")
    return sql(", vp AS (SELECT case_id, pos, item_id FROM vprompts)," + head + more
               + f"  alike AS ({similar}),\n" + tail + "\n" + body,
               "vtrain", "vprompts", "vecs")


_MEANS = """
  pdim AS (SELECT case_id, i, sum(pw * v[i]) / sum(pw) AS x
           FROM pvec JOIN vecs USING (item_id), range(1, 65) r(i) GROUP BY 1, 2),
  pv AS (SELECT case_id, list(x ORDER BY i) AS x FROM pdim GROUP BY 1),
  sdim AS (SELECT session_id, i, avg(v[i]) AS y
           FROM vtrain JOIN vecs USING (item_id), range(1, 65) r(i) GROUP BY 1, 2),
  sv AS (SELECT session_id, list(y ORDER BY i) AS y FROM sdim GROUP BY 1),
"""
QUERIES["recommend_vectors_mean_k21_k22"] = _recommend_vectors(EMB)
SQL["recommend_vectors_mean_k21_k22"] = vector_template(
    EMB, "SELECT *, round(list_cosine_similarity(x, y), 9) AS sim FROM counted"
         " JOIN pv USING (case_id) JOIN sv USING (session_id)", _MEANS)

_LASTS = """
  pv AS (SELECT case_id, v AS x FROM nprompt JOIN vecs USING (item_id) WHERE pos = n),
  sv AS (SELECT session_id, v AS y FROM vtrain t JOIN vecs USING (item_id)
         WHERE pos = (SELECT max(pos) FROM vtrain u WHERE u.session_id = t.session_id)),
"""
QUERIES["recommend_vectors_last_k21_k22"] = _recommend_vectors(EMB_LAST)
SQL["recommend_vectors_last_k21_k22"] = vector_template(
    EMB_LAST, "SELECT *, round(list_inner_product(x, y), 9) AS sim FROM counted"
              " JOIN pv USING (case_id) JOIN sv USING (session_id)", _LASTS)

_CONCATS = """
  pparts AS (SELECT case_id, n - pos AS back, list_transform(v, lambda q: q * pw) AS x
             FROM pvec JOIN vecs USING (item_id)),
  sparts AS (SELECT session_id, m - pos AS back, v AS y FROM (
               SELECT session_id, item_id, pos, max(pos) OVER (PARTITION BY session_id) AS m
               FROM vtrain) JOIN vecs USING (item_id)),
  aligned AS (SELECT s.case_id, s.session_id, sum(list_inner_product(x, y)) AS xy,
                     sum(list_inner_product(x, x)) AS xx, sum(list_inner_product(y, y)) AS yy
              FROM sampled s JOIN pparts p ON p.case_id = s.case_id
              JOIN sparts t ON t.session_id = s.session_id AND t.back = p.back GROUP BY 1, 2),
"""
QUERIES["recommend_vectors_concat_k23"] = _recommend_vectors(EMB_CONCAT)
SQL["recommend_vectors_concat_k23"] = vector_template(
    EMB_CONCAT, "SELECT *, round(xy / sqrt(xx * yy), 9) AS sim FROM counted"
                " JOIN aligned USING (case_id, session_id)", _CONCATS)
