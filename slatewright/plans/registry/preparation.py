"""Queries on cleaning, ids, splits and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatewright.functions import text as X
from slatewright.operators import cases, cleaning, ids, splitting
from slatewright.operators.popularity import item_counts
from slatewright.plans import workload
from slatewright.plans.prepared import dataset, load_and_split, log_table
from slatewright.plans.registry.common import sql
from slatewright.sources.readers import parse_literals, parse_metadata

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, query, text=None, *needs):
    QUERIES[name] = query
    if text is not None:
        SQL[name] = sql(text, *needs)


def table(spark, sf_dir, name):
    return workload.table(spark, sf_dir, name)


# --- sources and scalar functions -------------------------------------------------------

add("ordered_log_s1_d15", lambda s, d: workload.interactions(s, d).select(
    "session_id", "pos", "item_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "reward"),
    "SELECT session_id, pos, item_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, reward FROM raw_log",
    "raw_log")


def reviews(spark, sf_dir):
    """Customers' orders written as JSON lines and parsed back with a schema."""
    lines = table(spark, sf_dir, "orders").select(F.to_json(F.struct(
        F.col("o_custkey").cast("string").alias("reviewerID"),
        F.col("o_orderkey").cast("string").alias("asin"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', o_orderdate)")
        .alias("unixReviewTime"))).alias("v"))
    schema = "reviewerID string, asin string, unixReviewTime long"
    return lines.select(F.from_json("v", schema).alias("r")).select(
        F.col("r.reviewerID").alias("user"), F.col("r.asin").alias("item"),
        F.col("r.unixReviewTime").alias("unix_time"), F.lit(1.0).alias("reward"))


add("json_reviews_s2", reviews, """
  SELECT o_custkey::VARCHAR AS user, o_orderkey::VARCHAR AS item,
         epoch(o_orderdate)::BIGINT AS unix_time, 1.0::DOUBLE AS reward FROM orders""")


def literal_lines(spark, sf_dir):
    """Parts as Python-style dictionaries; every third line carries u-prefixed strings."""
    part = table(spark, sf_dir, "part")
    u = F.when(F.col("p_partkey") % 3 == 0, "u").otherwise("")
    value = F.concat(F.lit("{'id': "), F.col("p_partkey").cast("string"), F.lit(", 'title': "), u,
                     F.lit("'"), "p_name", F.lit("', 'tags': ["), u, F.lit("'"), "p_type",
                     F.lit("', "), u, F.lit("'"), "p_brand", F.lit("']}"))
    good, _ = parse_literals(part.select(value.alias("value")),
                             "id long, title string, tags array<string>")
    return good.select("id", "title", X.sorted_label(F.col("tags")).alias("label"))


add("literal_lines_s3_p5", literal_lines, """
  SELECT p_partkey AS id, p_name AS title,
         least(p_type, p_brand) || '_' || greatest(p_type, p_brand) AS label FROM part""")


def metadata(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tail = F.when(F.col("p_partkey") % 2 == 0, ", 'price': 1}").otherwise("}")
    value = F.concat(F.lit("{'asin': '"), F.col("p_partkey").cast("string"),
                     F.lit("', 'title': ' "), "p_name", F.lit(" &amp; "), "p_brand",
                     F.lit("&trade;&nbsp;'"), tail)
    return parse_metadata(part.select(value.alias("value")))


add("metadata_scan_s4_p3_p4", metadata, """
  SELECT p_partkey::VARCHAR AS item, ' ' || p_name || '  and  ' || p_brand || ' ' AS name
  FROM part""")

add("titles_from_pages_s4_p3", lambda s, d: table(s, d, "pages").select("page_id", F.length(
    X.clean_entities(X.between(F.col("html"), "<title>", "</title>"))).alias("n_chars")), """
  SELECT page_id, length(replace(replace(replace(replace(replace(replace(replace(replace(replace(
         replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1),
         '&amp;', ' and '), '&lt;', ''), '&gt;', ''), '&ndash', ''), '&mdash;', ''), '&ensp;', ''),
         '&nbsp;', ' '), '&shy;', ''), '&copy;', ''), '&trade;', ''), '&reg;', ''), '&quot;', ''))
         AS n_chars FROM pages""")


def vectors_text(spark, sf_dir):
    from slatewright.functions.vectors import parse_vector
    text = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.to_json(F.col("embedding").cast("array<double>")).alias("t"))
    v = parse_vector("t")
    return text.select("vec_id", F.size(v).alias("dim"), F.round(v[0], 6).alias("first"),
                       F.round(F.element_at(v, -1), 6).alias("last"))


add("vectors_from_text_s5_p11", vectors_text, """
  SELECT vec_id, len(embedding)::INTEGER AS dim, round(embedding[1]::DOUBLE, 6) AS first,
         round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings""")

add("lookup_s6", lambda s, d: workload.names(s, d), """
  SELECT p_partkey AS item_id, p_name || ' #' || p_partkey AS name FROM part""")

add("time_formats_p1_p2", lambda s, d: table(s, d, "events").select(
    "event_id",
    F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))),
                  "yyyy-MM-dd HH:mm:ss").alias("second"),
    F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss.SSS").alias("day")), """
  SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second,
         strftime(date_trunc('day', ts), '%Y-%m-%d 00:00:00.000') AS day FROM events""")

add("reject_counts_p6", lambda s, d: cleaning.reject_counts(
    table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), ["text", "quality", "toxic"]),
    """
  SELECT count(*) AS n_rows, count_if(text IS NULL OR quality IS NULL OR toxic IS NULL)::BIGINT AS n_rejected,
         count_if(text IS NULL)::BIGINT AS missing_text, count_if(quality IS NULL)::BIGINT AS missing_quality,
         count_if(toxic IS NULL)::BIGINT AS missing_toxic FROM documents LEFT JOIN labels USING (doc_id)""")

add("tidy_p7", lambda s, d: cleaning.tidy(
    table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select(
        "doc_id", "quality", "n_chars"),
    {"doc_id": "item_id"}, {"quality": "long", "n_chars": "string"}, ["item_id", "quality"]), """
  SELECT doc_id AS item_id, quality::BIGINT AS quality, n_chars::VARCHAR AS n_chars
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")


def half_named(spark, sf_dir):
    """Vectors with the part's name where the part is large, else without a name."""
    part = table(spark, sf_dir, "part").where("p_size >= 25").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    return workload.vectors(spark, sf_dir).join(part, "item_id", "left")


part_sql = """SELECT vec_id AS item_id, p_name AS name, embedding::DOUBLE[] AS v
  FROM embeddings LEFT JOIN (SELECT * FROM part WHERE p_size >= 25) ON p_partkey = vec_id"""

add("unnamed_items_p8_p10", lambda s, d: cleaning.fill_unnamed(half_named(s, d), 64).select(
    "item_id", "name", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, b: a + F.abs(b)), 6)
    .alias("mass")), f"""
  SELECT item_id, coalesce(name, 'Unknown item') AS name, round(CASE WHEN name IS NULL THEN 0.0::DOUBLE
         ELSE list_sum(list_transform(v, lambda x: abs(x))) END, 6) AS mass FROM ({part_sql})""")

add("vector_lengths_p9", lambda s, d: cleaning.vector_lengths(
    cleaning.drop_unnamed(cleaning.fill_unnamed(half_named(s, d), 64))), f"""
  SELECT len(v)::INTEGER AS dim, count(*) AS n FROM ({part_sql}) WHERE name IS NOT NULL GROUP BY 1""")

# --- ids --------------------------------------------------------------------------------


def mapping(spark, sf_dir):
    return ids.dense_ids(log_table(spark, sf_dir), "item_id", ["ts", "session_id", "pos"])


MAP = """mapping AS (SELECT item_id, row_number() OVER (ORDER BY ts, session_id, pos) - 1 AS idx
  FROM (SELECT DISTINCT ON (item_id) item_id, ts, session_id, pos FROM raw_log
        ORDER BY item_id, ts, session_id, pos))"""

add("dense_ids_i1_i5", lambda s, d: ids.lookup_array(mapping(s, d)),
    f", {MAP} SELECT item_id, idx FROM mapping", "raw_log")


def test_in_dense(spark, sf_dir):
    """All sessions in the ids of the early half; later items are unknown."""
    log = log_table(spark, sf_dir)
    early = log.where("ts < timestamp_ntz '1995-09-01'")
    known = ids.dense_ids(early, "item_id", ["ts", "session_id", "pos"])
    return ids.to_dense(log.select("session_id", "pos", "item_id"), known)


EARLY = MAP.replace("FROM raw_log", "FROM raw_log WHERE ts < TIMESTAMP '1995-09-01'")
add("to_dense_i2", test_in_dense, f""", {EARLY}
  SELECT session_id, pos, coalesce(idx, -1)::BIGINT AS item_id FROM raw_log LEFT JOIN mapping USING (item_id)""",
    "raw_log")


def dense_arrays(spark, sf_dir):
    log = log_table(spark, sf_dir)
    early = log.where("ts < timestamp_ntz '1995-09-01'")
    known = ids.dense_ids(early, "item_id", ["ts", "session_id", "pos"])
    lists = cases.as_arrays(log, ["session_id"]).withColumnRenamed("session_id", "case_id")
    return ids.arrays_to_dense(lists, known).select(
        "case_id", F.array_join("items", ",").alias("items"))


add("arrays_to_dense_i3", dense_arrays, f""", {EARLY}
  SELECT session_id AS case_id, string_agg(coalesce(idx, -1)::VARCHAR, ',' ORDER BY pos) AS items
  FROM raw_log LEFT JOIN mapping USING (item_id) GROUP BY 1""", "raw_log")

add("to_original_i4", lambda s, d: ids.to_original(ids.to_dense(
    log_table(s, d).select("session_id", "pos", "item_id"), mapping(s, d)), mapping(s, d)),
    "SELECT session_id, pos, item_id FROM raw_log", "raw_log")


def known_slates(spark, sf_dir):
    rows = log_table(spark, sf_dir)
    early = rows.where("ts < timestamp_ntz '1995-09-01'")
    known = ids.dense_ids(early, "item_id", ["ts", "session_id", "pos"])
    slates = rows.select(F.col("session_id").alias("case_id"), F.col("pos").alias("rank"), "item_id")
    return ids.map_known(slates, known).select("case_id", F.col("rank").cast("long"), "item_id")


add("map_known_i6", known_slates, f""", {EARLY}
  SELECT session_id AS case_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS rank,
         idx AS item_id FROM raw_log JOIN mapping USING (item_id)""", "raw_log")

# --- cleaning ---------------------------------------------------------------------------

add("known_and_used_items_d1", lambda s, d: cleaning.used_items(
    table(s, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("item_id"), "p_brand"),
    cleaning.with_known_items(log_table(s, d), table(s, d, "part").where("p_retailprice > 950").select(
        F.col("p_partkey").alias("item_id")))), """
  SELECT p_partkey AS item_id, p_brand FROM part WHERE p_size <= 10 AND p_retailprice > 950
     AND p_partkey IN (SELECT item_id FROM raw_log)""", "raw_log")

add("first_interactions_d2", lambda s, d: cleaning.first_interactions(
    log_table(s, d).select("session_id", "item_id", "pos")), """
  SELECT session_id, item_id, min(pos) AS pos FROM raw_log GROUP BY 1, 2""", "raw_log")

add("unique_items_d3", lambda s, d: cleaning.unique_items(table(s, d, "documents").select(
    F.col("n_chars").alias("item_id"), "doc_id", "lang"), ["doc_id"]), """
  SELECT n_chars AS item_id, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1""")

add("duplicate_items_d3", lambda s, d: cleaning.duplicate_items(table(s, d, "documents").select(
    F.col("n_chars").alias("item_id"))), """
  SELECT n_chars AS item_id, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1""")

CORE = 22


def core_rounds(n: int) -> str:
    steps, prev = [], "SELECT session_id, item_id, pos FROM raw_log"
    for i in range(n):
        steps.append(f"s{i} AS MATERIALIZED (SELECT * FROM ({prev}) WHERE session_id IN "
                     f"(SELECT session_id FROM ({prev}) GROUP BY 1 HAVING count(*) >= {CORE}))")
        steps.append(f"i{i} AS MATERIALIZED (SELECT * FROM s{i} WHERE item_id IN "
                     f"(SELECT item_id FROM s{i} GROUP BY 1 HAVING count(*) >= {CORE}))")
        prev = f"SELECT * FROM i{i}"
    return ", " + ",\n".join(steps) + f" SELECT session_id, item_id, pos FROM i{n - 1}"


add("k_core_d4", lambda s, d: cleaning.k_core(
    log_table(s, d).select("session_id", "item_id", "pos"), CORE), core_rounds(8), "raw_log")

add("sample_sessions_d5", lambda s, d: splitting.sample_sessions(log_table(s, d), 100, 7).select(
    "session_id", "pos", "item_id"), """
  SELECT session_id, pos, item_id FROM raw_log WHERE session_id IN (
    SELECT session_id FROM ends ORDER BY md5('7:' || session_id), session_id LIMIT 100)""", "ends")

# --- splits -----------------------------------------------------------------------------

add("sessions_in_time_d6", lambda s, d: splitting.sessions_in_time(log_table(s, d)).select(
    "session_id", "session_rank", F.date_format("max_ts", "yyyy-MM-dd").alias("day")), """
  SELECT session_id, row_number() OVER (ORDER BY max_ts, session_id) AS session_rank,
         strftime(max_ts, '%Y-%m-%d') AS day FROM ends""", "ends")

add("split_fraction_d7", lambda s, d: splitting.temporal_split_fraction(log_table(s, d), 0.2),
    "SELECT session_id, role FROM roles", "roles")

add("split_cutoff_d8", lambda s, d: splitting.temporal_split_cutoff(
    log_table(s, d), "2001-10-01 00:00:00"), """
  SELECT session_id, CASE WHEN max_ts >= TIMESTAMP '2001-10-01' THEN 'test' ELSE 'train' END AS role
  FROM ends""", "ends")

SHUFFLED = """shuffled AS (SELECT session_id, row_number() OVER (
    ORDER BY md5('42:' || session_id), session_id) AS rn, count(*) OVER () AS total FROM ends)"""

add("split_random_d9", lambda s, d: splitting.random_split(log_table(s, d), 0.3, 42), f""", {SHUFFLED}
  SELECT session_id, CASE WHEN rn <= floor((1 - 0.3::DOUBLE) * total) THEN 'train' ELSE 'test' END AS role
  FROM shuffled""", "ends")

add("folds_random_d10_d14", lambda s, d: splitting.SplitOptions(
    num_folds=4, fold_strategy="cross").folds(log_table(s, d)), """
  , binned AS (SELECT session_id, ntile(4) OVER (ORDER BY md5('42:' || session_id), session_id) AS bin FROM ends)
  SELECT session_id, fold::INTEGER AS fold, CASE WHEN bin = fold THEN 'validation' ELSE 'train' END AS role
  FROM binned, range(1, 5) f(fold)""", "ends")

add("folds_chain_d11_d13", lambda s, d: splitting.forward_chaining_folds(log_table(s, d), 3), """
  , binned AS (SELECT session_id, ntile(4) OVER (ORDER BY max_ts, session_id) AS bin FROM ends)
  SELECT session_id, fold::INTEGER AS fold, CASE WHEN bin <= fold THEN 'train' ELSE 'validation' END AS role
  FROM binned, range(1, 4) f(fold) WHERE bin <= fold + 1""", "ends")

CUTS = ("2001-08-01 00:00:00", "2001-09-15 00:00:00", "2001-10-15 00:00:00")
add("folds_cutoff_d12_d13", lambda s, d: splitting.cutoff_folds(log_table(s, d), CUTS), """
  , binned AS (SELECT session_id, 1 + (max_ts >= TIMESTAMP '2001-08-01')::INT +
      (max_ts >= TIMESTAMP '2001-09-15')::INT + (max_ts >= TIMESTAMP '2001-10-15')::INT AS bin FROM ends)
  SELECT session_id, fold::INTEGER AS fold, CASE WHEN bin <= fold THEN 'train' ELSE 'validation' END AS role
  FROM binned, range(1, 4) f(fold) WHERE bin <= fold + 1""", "ends")


def untrained(spark, sf_dir):
    """A split whose short train side leaves some test items unseen."""
    log = log_table(spark, sf_dir)
    labelled = splitting.with_roles(log, splitting.temporal_split_fraction(log, 0.95))
    kept = splitting.drop_untrained(labelled.where("role = 'train'"), labelled.where("role = 'test'"))
    return kept.select("session_id", "pos", "item_id")


add("drop_untrained_d16", untrained, """
  , r AS (SELECT session_id, CASE WHEN row_number() OVER (ORDER BY max_ts, session_id) >
             count(*) OVER () - ceil(0.95 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS role FROM ends),
  l AS (SELECT * FROM raw_log JOIN r USING (session_id)),
  k AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS m FROM l WHERE role = 'test'
        AND item_id IN (SELECT item_id FROM l WHERE role = 'train'))
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS pos, item_id
  FROM k WHERE m >= 2""", "ends", "raw_log")

add("test_sessions_d16_d20", lambda s, d: load_and_split(log_table(s, d)).test.select(
    "session_id", "pos", "item_id"), "SELECT session_id, pos, item_id FROM test", "test")

add("prompts_d17", lambda s, d: cases.prompts(dataset(s, d).test, 3), """
  SELECT session_id AS case_id, pos, item_id FROM test WHERE pos <= n - 3""", "test")

add("ground_truths_d18", lambda s, d: cases.ground_truths(dataset(s, d).test, 3), """
  SELECT session_id AS case_id, pos - n + 3 AS pos, item_id FROM test WHERE pos > n - 3 AND n > 3""",
    "test")

EVOLVING = """, m AS (SELECT max(session_id) AS mx FROM test)"""
add("evolving_prompts_d19", lambda s, d: cases.evolving_prompts(dataset(s, d).test), EVOLVING + """
  SELECT (i * 2 * mx + session_id + 1)::BIGINT AS case_id, pos, item_id
  FROM test, m, range(0, 200) r(i) WHERE i <= n - 2 AND pos <= i + 1""", "test")

add("evolving_recent_prompts_d19", lambda s, d: cases.evolving_prompts(
    dataset(s, d).test, last_items=5), EVOLVING + """
  SELECT (i * 2 * mx + session_id + 1)::BIGINT AS case_id, (pos - greatest(0, i + 1 - 5))::BIGINT AS pos, item_id
  FROM test, m, range(0, 200) r(i) WHERE i <= n - 2 AND pos <= i + 1 AND pos > i + 1 - 5""", "test")

add("evolving_cases_d19", lambda s, d: cases.evolving_cases(dataset(s, d).test), EVOLVING + """
  SELECT ((pos - 1) * 2 * mx + session_id + 1)::BIGINT AS case_id, session_id, pos AS upto
  FROM test, m WHERE pos <= n - 1""", "test")

add("evolving_truths_d19", lambda s, d: cases.evolving_truths(dataset(s, d).test, 2), EVOLVING + """
  SELECT (i * 2 * mx + session_id + 1)::BIGINT AS case_id, (pos - 1 - i)::BIGINT AS pos, item_id
  FROM test, m, range(0, 200) r(i) WHERE i <= n - 3 AND pos > i + 1 AND pos <= i + 3""", "test")

add("inner_validation_d21", lambda s, d: splitting.inner_validation(dataset(s, d).train, 0.1, 42), """
  SELECT session_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || session_id), session_id) <=
         ceil(0.1::DOUBLE * count(*) OVER ()) THEN 'validation' ELSE 'train' END AS role
  FROM (SELECT DISTINCT session_id FROM train)""", "train")


def inner_cases(spark, sf_dir):
    """Prompts and truths of 100 held-back training sessions at most, in one table."""
    _, prompts, truths = splitting.inner_validation_cases(dataset(spark, sf_dir).train, 0.1, 42, at_most=100)
    return prompts.withColumn("part", F.lit("prompt")).unionByName(truths.withColumn("part", F.lit("truth")))


add("inner_validation_cases_d21", inner_cases, """
  , ranked AS (SELECT session_id, row_number() OVER (ORDER BY md5('42:' || session_id), session_id) <=
                 least(100, ceil(0.1::DOUBLE * count(*) OVER ())) AS held FROM (SELECT DISTINCT session_id FROM train)),
  kept AS (SELECT session_id, pos, item_id, count(*) OVER (PARTITION BY session_id) AS m FROM train JOIN ranked USING (session_id)
           WHERE held AND item_id IN (SELECT item_id FROM train JOIN ranked USING (session_id) WHERE NOT held)),
  numbered AS (SELECT session_id, item_id, m, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS pos FROM kept WHERE m >= 2)
  SELECT session_id AS case_id, CASE WHEN pos < m THEN pos ELSE 1 END AS pos, item_id,
         CASE WHEN pos < m THEN 'prompt' ELSE 'truth' END AS part FROM numbered""", "train")


def named_truths(spark, sf_dir):
    train = dataset(spark, sf_dir).train
    unnamed = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("item_id"))
    return cases.ground_truths(cases.named_only(train, unnamed)).select("case_id", "item_id")


add("named_truths_d22", named_truths, """
  SELECT session_id AS case_id, arg_max(item_id, pos) AS item_id FROM train
  WHERE session_id NOT IN (SELECT session_id FROM train JOIN part ON p_partkey = item_id WHERE p_size = 1)
  GROUP BY 1 HAVING count(*) > 1""", "train")

add("item_counts_a2", lambda s, d: item_counts(dataset(s, d).train),
    "SELECT item_id, c AS count FROM counts", "counts")
