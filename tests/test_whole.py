"""Nothing is lost: long lists, unnamed items, unknown popularity, short pauses, long chains."""

from pyspark.sql import functions as F

from slatewright.operators import cleaning, completions, evaluation, hybrids, prompts, sequences, splitting
from slatewright.streaming import online


def test_long_and_unnamed_lists_stay(spark):
    rows = spark.range(5_000).select(F.lit(1).alias("case_id"), F.col("id").alias("pos"), F.col("id").alias("item_id"))
    names = spark.range(4_990).select(F.col("id").alias("item_id"), F.concat(F.lit("n"), "id").alias("name"))
    listed = prompts.named_lists(rows, names).first().names
    assert len(listed) == 5_000 and listed[7] == "n7" and listed[4_995] == "item 4995"


def test_rejected_examples_are_a_table(spark):
    examples = spark.createDataFrame([(1, "a b c"), (2, "a")], "case_id long, t string").select(
        "case_id", F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))).alias("messages"))
    lengths = spark.createDataFrame([(1, 5), (2, 5)], "case_id long, length int")
    whole = prompts.training_split(examples, lengths, max_tokens=None)
    limit = min(r.n_tokens for r in whole.collect())
    kept = prompts.training_split(examples, lengths, max_tokens=limit)
    rest = prompts.beyond_limit(examples, lengths, max_tokens=limit)
    assert {r.case_id for r in kept.collect()} == {2} and {r.case_id for r in rest.collect()} == {1}


def test_answers_beyond_a_hundred_thousand_do_not_collide(spark):
    rows = spark.createDataFrame([(1, 0, 100_001, "a"), (1, 1, 1, "b"), (1, 0, 2, "c")],
                                 "case_id long, candidate int, rank int, name string")
    firsts = {r["name"]: r["first"] for r in completions.answer_counts(rows).collect()}
    assert sorted(firsts, key=firsts.get) == ["c", "a", "b"]


def test_names_without_vector_keep_their_rank(spark):
    items = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "item_id long, embedding array<double>")
    rows = spark.createDataFrame([(1, 1, "x", None), (1, 2, "gone", None), (1, 3, "y", 3), (1, 4, "z", None)],
                                 "case_id long, rank int, name string, item_id long")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("z", [1.0, 0.0])], "name string, vector array<double>")
    got = {r["rank"]: r.item_id for r in completions.fill_unmatched(rows, vectors, items, 1).collect()}
    assert got == {1: 2, 2: None, 3: 3, 4: 1}


def test_unknown_popularity_counts_as_none(spark):
    slate = lambda ids: spark.createDataFrame([(1, k + 1, i) for k, i in enumerate(ids)], "case_id long, rank int, item_id long")
    popularity = spark.createDataFrame([(1, 5), (2, 5)], "item_id long, popularity long")
    cutoffs = spark.createDataFrame([(0.5, 3)], "quantile double, cutoff long")
    last = spark.createDataFrame([(1, 99)], "case_id long, item_id long")
    switched = hybrids.popularity_switch(slate([1]), slate([2]), last, popularity, cutoffs, 5).collect()
    assert [r.item_id for r in switched] == [2]
    filtered = hybrids.popularity_filter(slate([77, 1, 2]), popularity, cutoffs, 3).collect()
    assert [r.item_id for r in sorted(filtered, key=lambda r: r["rank"])] == [77, 1, 2]


def test_inner_validation_has_no_hidden_limit(spark):
    log = spark.range(4_000).select(F.col("id").alias("session_id"))
    assert splitting.inner_validation(log, 0.5, 1).where("role = 'validation'").count() == 2_000
    assert splitting.inner_validation(log, 0.5, 1, at_most=500).where("role = 'validation'").count() == 500


def test_samples_follow_weights_at_large_counts(spark):
    counts = spark.range(3_000).select(F.col("id").alias("item_id"), F.lit(10**15).alias("count"))
    cases = spark.range(2).withColumnRenamed("id", "case_id")
    rows = evaluation.negative_samples(cases, counts, 50, 1).collect()
    drawn = [{r.item_id for r in rows if r.case_id == c} for c in (0, 1)]
    assert all(len(d) == 50 and max(d) > 1_000 for d in drawn) and drawn[0] != drawn[1]


def test_gaps_are_cut_per_case(spark):
    rows = spark.createDataFrame([(1, p, p) for p in range(1, 10)] + [(2, 1, 4), (2, 2, -1), (2, 3, -1), (2, 4, 5)],
                                 "case_id long, pos long, item_id long")
    got = {r.case_id: r.sequence for r in sequences.sequence_table(rows, 3).collect()}
    assert got == {1: [7, 8, 9], 2: [-1, 4, 5]}


def test_core_of_a_long_chain(spark):
    """Sessions k hold items k and k + 1: with two rows wanted everything peels off from the ends."""
    chain = [(k, i) for k in range(12) for i in (k, k + 1)]
    ring = [(100 + k, 100 + (k + d) % 4) for k in range(4) for d in (0, 1)]
    log = spark.createDataFrame(chain + ring, "session_id long, item_id long")
    assert {tuple(r) for r in cleaning.k_core(log, 2).collect()} == set(ring)
    assert cleaning.k_core(log.limit(0), 2).count() == 0


def test_sessions_that_end_within_a_batch_are_emitted(spark, tmp_path):
    clicks = [(1, 10, "2024-01-01 00:00:00", 1), (1, 11, "2024-01-01 00:01:00", 2), (1, 20, "2024-01-01 05:00:00", 3)]
    table = spark.createDataFrame(clicks, "session_id long, item_id long, ts string, order_id long").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = online.click_stream(spark, f"{tmp_path}/in", table.schema.simpleString()[7:-1].replace(":", " "))
    query = (online.running_prompts(stream, 5, 3600).writeStream.format("memory").queryName("ended_sessions")
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    got = sorted((r["items"], r.closed) for r in spark.table("ended_sessions").collect())
    assert got[:2] == [([10, 11], True), ([20], False)]


def test_one_prompt_as_a_table(spark):
    from slatewright.operators import neighbours as N

    train = spark.createDataFrame([(s, (s + k) % 9, 1000 + s * 10 + k, 1.0, k + 1) for s in range(30) for k in range(4)],
                                  "session_id long, item_id long, ts long, reward double, pos long")
    prompt = [0, 3, 5]
    table = spark.createDataFrame([(77, i + 1, x, "more") for i, x in enumerate(prompt)], "case_id long, pos long, item_id long, other string")
    listed = N.recommend_one(prompt, train, 5).select("rank", "item_id", "score").collect()
    assert listed and sorted(N.recommend_one(table, train, 5).select("rank", "item_id", "score").collect()) == sorted(listed)


def test_json_report_holds_every_metric(spark, monkeypatch):
    from slatewright.plans.registry import evaluating

    report = spark.createDataFrame([("m", 10, "NDCG", 0.5), ("m", 10, "Catalog coverage", 0.25)], "model string, top_k int, metric string, value double")
    monkeypatch.setattr(evaluating, "two_model_report", lambda s, d: report)
    (row,) = evaluating.QUERIES["report_json_n14"](spark, "").collect()
    assert "Catalog coverage@10" in row.json and "NDCG@10" in row.json
