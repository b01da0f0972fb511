"""Queries on sequence tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewright.functions.vectors import norm
from slatewright.operators import cases, ids, reduction
from slatewright.operators import sequences as Q
from slatewright.plans import workload
from slatewright.plans.prepared import dataset
from slatewright.plans.registry.common import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, query, text=None, *needs):
    QUERIES[name] = query
    if text is not None:
        SQL[name] = sql(text, *needs)


def joined(*columns):
    return [F.array_join(c, ",").alias(c) for c in columns]


def rows(spark, sf_dir):
    """Prompts with rare items unknown (-1): those in fewer than 15 training rows."""
    data = dataset(spark, sf_dir)
    frequent = data.train.groupBy("item_id").count().where("count >= 15").select("item_id")
    return data.prompts.join(frequent.withColumn("_known", F.lit(True)), "item_id", "left").select(
        "case_id", "pos", F.when(F.col("_known"), F.col("item_id")).otherwise(-1).alias("item_id"))


SEQ = """
  , kept AS (SELECT case_id, pos, p.item_id, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS back
             FROM prompts p JOIN counts USING (item_id) WHERE c >= 15),
  slots AS (SELECT case_id, b AS back FROM (SELECT DISTINCT case_id FROM kept), range(1, {n} + 1) r(b)),
  seq AS (SELECT s.case_id, {n} - s.back + 1 AS i, coalesce(item_id, -1) AS x
          FROM slots s LEFT JOIN kept k ON k.case_id = s.case_id AND k.back = s.back),
  nxt AS (SELECT *, lead(x) OVER (PARTITION BY case_id ORDER BY i) AS y FROM seq)"""
NEED = ("prompts", "counts")
N = 30


def agg(expression, alias, where="true"):
    return f"string_agg(({expression})::VARCHAR, ',' ORDER BY i) FILTER (WHERE {where}) AS {alias}"


add("sequences_q1", lambda s, d: Q.sequence_table(rows(s, d), N).select("case_id", *joined("sequence")),
    SEQ.format(n=N) + f" SELECT case_id, {agg('x', 'sequence')} FROM seq GROUP BY 1", *NEED)
add("next_items_q2", lambda s, d: Q.next_item_rows(rows(s, d), N).select("case_id", *joined("input", "target")),
    SEQ.format(n=N + 1) + f" SELECT case_id, {agg('x', 'input', f'i <= {N}')},"
    f" {agg('CASE WHEN x = -1 THEN -1 ELSE y END', 'target', f'i <= {N}')} FROM nxt GROUP BY 1", *NEED)
add("next_item_prediction_q3", lambda s, d: Q.next_item_prediction_rows(rows(s, d), N).select(
    "case_id", *joined("input")),
    SEQ.format(n=N + 1) + f" SELECT case_id, {agg('x', 'input', 'i >= 2')} FROM seq GROUP BY 1", *NEED)
add("next_item_validation_q3", lambda s, d: Q.next_item_validation_rows(rows(s, d), N).select(
    "case_id", *joined("input", "target")),
    SEQ.format(n=N + 1) + f" SELECT case_id, {agg('x', 'input', f'i <= {N}')},"
    f" {agg(f'CASE WHEN i = {N + 1} THEN x ELSE -1 END', 'target', 'i >= 2')} FROM seq GROUP BY 1", *NEED)

MASK = 1_000_000
U = ("(('0x' || substr(md5('42:' || case_id || ':' || copy || ':' || (i - 1)), 1, 8))::BIGINT + 0.5::DOUBLE)"
     " / 4294967296.0::DOUBLE")
add("cloze_q4_q5_q6", lambda s, d: Q.cloze_rows(rows(s, d), N, F.lit(MASK).cast("long"), 0.3, 42).select(
    "case_id", "copy", *joined("input", "target")),
    SEQ.format(n=N) + f""",
  cz AS (SELECT case_id, i, x, copy::INTEGER AS copy, x <> -1 AND CASE WHEN copy = 0 THEN i = {N} ELSE {U} < 0.3 END AS m
         FROM seq, range(0, 11) r(copy))
  SELECT case_id, copy, {agg(f'CASE WHEN m THEN {MASK} ELSE x END', 'input')},
         {agg('CASE WHEN m THEN x ELSE -1 END', 'target')} FROM cz GROUP BY 1, 2""", *NEED)
add("cloze_prediction_q8", lambda s, d: Q.cloze_prediction_rows(rows(s, d), N, F.lit(MASK).cast("long")).select(
    "case_id", *joined("input")),
    SEQ.format(n=N) + f" SELECT case_id, input || ',{MASK}' AS input FROM (SELECT case_id, {agg('x', 'input', 'i >= 2')} FROM seq GROUP BY 1)",
    *NEED)
def whole_space(spark, sf_dir):
    """All item ids of the catalogue; an id outside would be an error."""
    space = workload.table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    return Q.multi_hot(dataset(spark, sf_dir).prompts, space)


add("multi_hot_p12", whole_space, """
  SELECT case_id, item_id, count(*) AS n FROM prompts GROUP BY 1, 2""", "prompts")


def recent(spark, sf_dir):
    arrays = cases.as_arrays(dataset(spark, sf_dir).prompts, max_items=12)
    return arrays.select("case_id", F.array_join("items", ",").alias("items"))


add("last_items_p13", recent, """
  SELECT case_id, string_agg(item_id::VARCHAR, ',' ORDER BY pos) AS items FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos DESC) AS back FROM prompts)
  WHERE back <= 12 GROUP BY 1""", "prompts")


def distinct_lists(spark, sf_dir):
    arrays = cases.as_arrays(cases.first_distinct(dataset(spark, sf_dir).prompts, 25))
    return arrays.select("case_id", F.array_join("items", ",").alias("items"))


add("distinct_lists_p14_p15", distinct_lists, """
  SELECT case_id, string_agg(item_id::VARCHAR, ',' ORDER BY pos) AS items FROM (
    SELECT case_id, item_id, min(pos) AS pos, row_number() OVER (PARTITION BY case_id ORDER BY min(pos)) AS r
    FROM prompts GROUP BY 1, 2) WHERE r <= 25 GROUP BY 1""", "prompts")


def initial_vectors(spark, sf_dir):
    """All axes of the reduced vectors in first-appearance order of their items."""
    train = dataset(spark, sf_dir, on_vectors=True).train
    mapping = ids.dense_ids(train, "item_id", ["ts", "session_id", "pos"])
    reduced = reduction.reduce_pca(workload.vectors(spark, sf_dir), 64)
    return Q.initial_vectors(mapping, reduced).select("idx", F.round(norm("embedding"), 6).alias("length"))


add("initial_vectors_q9", initial_vectors, """
  , mean AS (SELECT i, avg(v[i]) AS m FROM vecs, range(1, 65) r(i) GROUP BY 1),
  len AS (SELECT item_id, round(sqrt(sum((v[i] - m) ** 2)), 6) AS length FROM vecs, mean GROUP BY 1),
  f AS (SELECT DISTINCT ON (item_id) item_id, ts, session_id, pos FROM vtrain ORDER BY item_id, ts, session_id, pos),
  mapping AS (SELECT item_id, row_number() OVER (ORDER BY ts, session_id, pos) - 1 AS idx FROM f)
  SELECT idx, length FROM mapping JOIN len USING (item_id)""", "vecs", "vtrain")
