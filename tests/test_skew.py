"""Split paths for large keys give what the plain ones give."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slatewright.operators import blocks, neighbours as N, ranking, stats
from slatewright.operators.ranking import rank_overall, rank_within, top_n


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(1 if i % 3 == 0 else i % 17, rng.randrange(60), i) for i in range(3000)]
    return spark.createDataFrame(data, "k long, v long, id long").cache()


def test_rank_within_splits_hot_keys(rows):
    plain = rows.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
    split = rank_within(rows, ["k"], [F.col("v"), F.col("id")], hot_rows=200)
    a = {(r["id"], r["pos"]) for r in plain.collect()}
    assert a == {(r["id"], r["pos"]) for r in split.select("id", "pos").collect()}


def test_rank_overall(rows):
    got = rank_overall(rows, [F.desc("v"), F.col("id")])
    order = [r["id"] for r in got.orderBy("pos").collect()]
    assert order == [r["id"] for r in rows.orderBy(F.desc("v"), "id").collect()]


def test_top_n_above_the_group_limit(rows):
    got = top_n(rows, ["k"], [F.col("v"), F.col("id")], 1001)
    expected = rows.withColumn("rank", F.row_number().over(
        Window.partitionBy("k").orderBy("v", "id"))).where("rank <= 1001")
    assert got.exceptAll(expected.select(got.columns)).isEmpty() and got.count() == expected.count()


def test_top_n_sends_n_rows_a_key_and_task(spark):
    """Null keys, keys over batch ends, and no more than n rows of a key from a task."""
    rows = spark.range(30_000).select((F.when(F.col("id") % 5 > 0, F.col("id") % 3)).alias("k"), F.hash("id").alias("v"), "id").repartition(3)
    cut = ranking._first_in_tasks(rows, ["k"], [F.col("v"), F.col("id")], 1500)
    assert max(r["count"] for r in cut.groupBy(F.spark_partition_id(), "k").count().collect()) == 1500
    got = top_n(rows, ["k"], [F.col("v"), F.col("id")], 1500)
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("v", "id"))).where("rank <= 1500")
    assert got.exceptAll(plain.select(got.columns)).isEmpty() and got.count() == plain.count()


@pytest.fixture(scope="module")
def log(spark):
    rng, data = random.Random(3), []
    for s in range(80):
        items = rng.sample(range(25), rng.randrange(3, 9))
        if s % 3:
            items = [100] + [i for i in items]  # one item in two thirds of the sessions
        if s % 2:
            items.append(101)
        data += [(s, x, f"2024-01-{1 + s % 28:02d} 00:00:00", 1.0, p + 1) for p, x in enumerate(items)]
    df = spark.createDataFrame(data, "session_id long, item_id long, ts string, reward double, pos long")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


@pytest.mark.parametrize("sampling", ["recent", "idf"])
def test_hot_items_do_not_change_neighbours(spark, log, sampling):
    prompts = log.where("session_id < 20").select(
        F.col("session_id").alias("case_id"), "pos", "item_id")
    train = log.where("session_id >= 20")
    results = []
    for hot_df, factor in ((1_000_000, 1_000), (12, 1)):
        options = N.NeighbourOptions(k=5, sample_size=8, sampling=sampling, decay="harmonic",
                                     sequential_weighting=True, hot_df=hot_df, draw_factor=factor)
        recs = N.recommend_neighbours(prompts, train, 10, options)
        results.append(sorted(tuple(r) for r in recs.collect()))
    assert results[0] == results[1] and len(results[0]) > 50


def test_hot_lists_stay_unread_where_the_sample_is_full(spark, log):
    """Prompts of two rare items and a hot one fill their sample before the hot item's list is needed."""
    index = N.NeighbourIndex.of(log)
    rows = [(c, p + 1, x) for c in range(8) for p, x in enumerate((c, c + 8, 100))] + [(50, 1, 100)]
    prompts = spark.createDataFrame(rows, "case_id long, pos long, item_id long")
    scored = N.prompt_vectors(N.normalised_prompts(prompts, index.items), None).join(index.items, "item_id")
    hot = scored.where("item_id = 100")
    best = N.overlaps(scored.where("item_id <> 100").join(index.postings.select("item_id", "session_id"), "item_id")
                      .select("case_id", "session_id").distinct(), scored, index)
    assert {r.case_id for r in N._open_cases(best, hot, 3).collect()} == {50}
    assert {r.case_id for r in N._open_cases(best, hot, 60).collect()} == {*range(8), 50}


@pytest.mark.parametrize("sampling", N.SAMPLINGS)
def test_ways_to_read_lists_do_not_change_samples(spark, log, sampling, monkeypatch):
    prompts = log.where("session_id < 20").select(F.col("session_id").alias("case_id"), "pos", "item_id")
    index, options = N.NeighbourIndex.of(log.where("session_id >= 20")), N.NeighbourOptions(
        k=5, sample_size=8, sampling=sampling, hot_df=12, draw_factor=1, idf_weighting=True)
    results = []
    for lookup, share in ((1024, 1), (2, 0)):
        monkeypatch.setattr(N, "LOOKUP", lookup)
        monkeypatch.setattr(N, "HOT_SHARE", share)
        vectors = N.prompt_vectors(N.normalised_prompts(prompts, index.items), "harmonic")
        pairs = N.sampled_pairs(vectors, index, options).select("case_id", "sample_rank", "session_id", "both", "last_pos", F.round("dot", 9))
        recs = N.recommend_neighbours(prompts, index, 10, options)
        results.append((sorted(tuple(r) for r in pairs.collect()), sorted(tuple(r) for r in recs.collect())))
    assert results[0] == results[1] and len(results[0][0]) > 50 and len(results[0][1]) > 50


def test_candidates_are_shuffled_as_sessions(spark, log):
    """Neighbours' items reach the case's task as one row a neighbour, and aren't shuffled again."""
    index = N.NeighbourIndex.of(log)
    prompts = log.where("session_id < 20").select(F.col("session_id").alias("case_id"), "pos", "item_id")
    options = N.NeighbourOptions(k=5, sample_size=8)
    items = N.prompt_vectors(N.normalised_prompts(prompts, index.items), None).localCheckpoint()
    pairs = items.select("case_id", (F.col("case_id") + 20).alias("session_id"), F.lit(1.0).alias("sim")).distinct().localCheckpoint()
    for scores in (N.scored_candidates(pairs, index.cells, items, index.items, options), N._whole_pairs(items.join(index.items, "item_id"), index)):
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\(case_id#\w+, (item|session)_id", plan)


@pytest.mark.parametrize("options", [
    dict(k=0), dict(k=10, sample_size=5), dict(sampling="other"), dict(similarity="none"),
    dict(decay="log", similarity="jaccard"), dict(prompt_strategy="concat"), dict(draw_factor=0)])
def test_neighbour_options_are_checked(options):
    with pytest.raises(ValueError):
        N.NeighbourOptions(**options)


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "item_id long, embedding array<double>")
    return x, df.cache()


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
@pytest.mark.parametrize("measure", blocks.MEASURES)
def test_tiles_equal_brute_force(items, measure, broadcast, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 7)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", broadcast)
    x, df = items
    queries = df.select(F.col("item_id").alias("case_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in blocks.nearest(queries, df, 7, measure).orderBy("case_id", "rank").collect():
        got.setdefault(r["case_id"], []).append(r["item_id"])
    scores = np.round(blocks._scores(x, x, measure), 9)
    for i in range(len(x)):
        assert got[i] == np.lexsort((np.arange(len(x)), -scores[i]))[:7].tolist()


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
@pytest.mark.parametrize("strict", [False, True])
def test_seen_items_come_last_or_not_at_all(items, broadcast, strict, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", broadcast)
    x, df = items
    seen = {i: list(range(i, 150, 3)) if i % 4 else ([] if i % 8 else None) for i in range(150)}
    queries = df.join(df.sparkSession.createDataFrame(list(seen.items()), "item_id long, seen array<long>"), "item_id").select(
        F.col("item_id").alias("case_id"), F.col("embedding").alias("vector"), "seen")
    got = {}
    for r in blocks.nearest(queries, df, -1, "dot", seen="seen", strict=strict).orderBy("case_id", "rank").collect():
        got.setdefault(r["case_id"], []).append(r["item_id"])
    scores = np.round(x @ x.T, 9)
    for i in range(150):
        shown = set(seen[i] or ())
        order = np.lexsort((np.arange(150), -scores[i])).tolist()
        assert got[i] == [j for j in order if j not in shown] + ([] if strict else [j for j in order if j in shown])


def test_pair_quantiles_and_moments(items, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    x, df = items
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = (unit @ unit.T)[np.triu_indices(len(x), 1)]
    levels = [0.0, 0.1, 0.5, 0.93, 1.0]
    assert blocks.similarity_quantiles(df, levels) == pytest.approx(np.quantile(pairs, levels).tolist(), abs=1e-9)
    assert blocks.cosine_moments(df) == pytest.approx((pairs.mean(), pairs.std()), abs=1e-9)
    both = np.concatenate([pairs, pairs])
    assert blocks.ordered_pair_quantiles(df, levels) == pytest.approx(np.quantile(both, levels).tolist(), abs=1e-9)


def test_pair_quantiles_of_copies(spark):
    """Copies have a cosine of exactly 1, which must not be lost between the passes."""
    x = np.array([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]] * 4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "item_id long, embedding array<double>")
    pairs = np.clip(x @ x.T, -1, 1)[np.triu_indices(len(x), 1)]
    levels = [0.0, 0.25, 0.5, 0.75, 1.0]
    assert blocks.similarity_quantiles(df, levels) == pytest.approx(np.quantile(pairs, levels).tolist(), abs=1e-9)


def test_item_blocks_are_copied_to_few_groups_of_queries(items, monkeypatch):
    monkeypatch.setattr(blocks, "QUERY_ROWS", 1)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    x, df = items
    queries = df.select(F.col("item_id").alias("case_id"), F.col("embedding").alias("vector"))
    found = blocks.nearest(queries, df, 3, "dot")
    assert found.rdd.getNumPartitions() == df.sparkSession.sparkContext.defaultParallelism
    monkeypatch.setattr(blocks, "STREAM_BYTES", (6 * 8 + 24) * 5)
    assert blocks.nearest(queries, df, 3, "dot").rdd.getNumPartitions() == max(30, df.sparkSession.sparkContext.defaultParallelism)


def test_rolling_mean_over_chunks(spark):
    series = spark.range(500).select(F.col("id").alias("step"), (F.col("id") * F.col("id") % 37).cast("double").alias("x"))
    got = [r["rolling"] for r in stats.rolling_mean(series, "x", window=16, chunk=50).orderBy("step").collect()]
    x = [float(i * i % 37) for i in range(500)]
    expected = [None] * 15 + [sum(x[i - 15:i + 1]) / 16 for i in range(15, 500)]
    assert got == pytest.approx(expected) if None not in got else got[:15] == [None] * 15
    assert got[15:] == pytest.approx(expected[15:])


def test_one_busy_day_and_sparse_ids(spark):
    """All rows on one day with random 64-bit ids: ranges, not days or id blocks, cut the sort."""
    busy = spark.range(20_000).select(F.xxhash64("id").alias("item_id"), F.lit("2024-01-01").cast("date").alias("ts"))
    got = rank_overall(busy, [F.col("ts"), F.col("item_id")])
    expected = busy.withColumn("pos", F.row_number().over(Window.orderBy("ts", "item_id")).cast("long"))
    assert got.select(expected.columns).exceptAll(expected).isEmpty() and got.count() == 20_000
    assert rank_overall(busy.limit(0), [F.col("ts")]).count() == 0
    within = rank_within(busy, ["ts"], [F.col("item_id")], hot_rows=100)
    assert within.select(expected.columns).exceptAll(expected).isEmpty() and within.count() == 20_000


def test_tasks_of_pairs_and_votes_follow_their_rows(spark, log, monkeypatch):
    """Rows that lists and sessions are multiplied to are spread by their number, and gathered lists aren't broadcast."""
    index = N.NeighbourIndex.of(log)
    prompts = log.where("session_id < 20").select(F.col("session_id").alias("case_id"), "pos", "item_id")
    items = N.prompt_vectors(N.normalised_prompts(prompts, index.items), None).localCheckpoint()
    scored = items.join(index.items, "item_id")
    pairs = items.select("case_id", (F.col("case_id") + 20).alias("session_id"), F.lit(1.0).alias("sim")).distinct().localCheckpoint()
    monkeypatch.setattr(ranking, "TASK_ROWS", 20)
    met = scored.agg(F.sum("df")).first()[0]
    votes = 5 * 20 * index.cells.agg(F.avg("s_size")).first()[0]
    for rows, n in ((N._whole_pairs(scored, index), met), (N.scored_candidates(
            pairs, index.cells, items, index.items, N.NeighbourOptions(k=5, sample_size=8)), votes)):
        tasks = -(-n // 20)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert tasks > 10 and re.search(rf"hashpartitioning\(case_id#\w+, {tasks:.0f}\), REPARTITION_BY_NUM", plan)
    for rows in (N.scored_candidates(pairs, index.cells, items, index.items, N.NeighbourOptions(k=5, sample_size=8)),
                 N.overlaps(pairs.select("case_id", "session_id"), scored, index)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[session_id#\w+\], \[session_id#\w+\]", plan)


def test_groups_of_queries_are_as_large_as_their_lists_allow(items, monkeypatch):
    """Lists of a few items leave room for many queries, so the blocks of items have few copies."""
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "HELD_ROWS", 3)
    x, df = items
    queries = df.select(F.col("item_id").alias("case_id"), F.col("embedding").alias("vector"))
    assert blocks.nearest(queries, df, 3, "dot").rdd.getNumPartitions() == df.sparkSession.sparkContext.defaultParallelism
