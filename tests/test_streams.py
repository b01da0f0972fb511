"""Slates, walks and session vectors pass as sorted rows: equal to the ways that move vectors, and narrower."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewright.operators import blocks, completions, hybrids, neighbours
from slatewright.operators.embedding import SimilarityOptions, recommend_similar


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, [float(x) for x in np.round(rng.normal(size=4), 2)]) for i in range(40)],
                                 "item_id long, embedding array<double>").cache()


@pytest.fixture(scope="module")
def prompts(spark):
    rng = np.random.default_rng(6)
    rows = [(c, p + 1, int(rng.integers(0, 44)) if c % 5 else None) for c in range(12) for p in range(3 + 9 * (c % 4))]
    return spark.createDataFrame(rows, "case_id long, pos long, item_id long").cache()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("options", [SimilarityOptions(), SimilarityOptions("euclidean", decay=None, strict=True),
                                     SimilarityOptions("dot", start_weights="CUBIC"), SimilarityOptions("dot", push_seen=False)])
@pytest.mark.parametrize("k", [4, -1])
def test_means_made_in_tasks_give_the_same_slates(prompts, items, options, k, small_batches, monkeypatch):
    found = rows(recommend_similar(prompts, items, k, options))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)  # vectors of sessions are made and moved
    wanted = rows(recommend_similar(prompts, items, k, options))
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    assert np.allclose([r[4] for r in found], [r[4] for r in wanted])


def test_session_vectors_are_not_moved(prompts, items):
    found = plan(recommend_similar(prompts, items, 4, SimilarityOptions()))
    assert found.count("Exchange") == 1 and "array" not in found.lower() and "Aggregate" not in found


def test_a_full_order_is_returned_in_small_batches(monkeypatch):
    monkeypatch.setattr(blocks, "TABLE_ROWS", 100)
    assert blocks._at_once(blocks.QUERY_ROWS, 40) == 2
    assert blocks._at_once(blocks.QUERY_ROWS, 2 * blocks.TABLE_ROWS) == 1


def slates(spark):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(c, r + 1, int(x)) for c in range(9) for r, x in enumerate(rng.integers(0, 43, 3 + 4 * c))],
                                 "case_id long, rank int, item_id long").cache()


def walked(rows, vectors, level, k):
    """A plain walk over one slate."""
    kept = []
    for item in dict.fromkeys(item for _, item in sorted(rows)):
        if item in vectors and len(kept) < k and all(vectors[item] @ vectors[x] < level for x in kept):
            kept.append(item)
    return kept


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_diversity_walks_equal_plain_ones(spark, items, broadcast, small_batches, monkeypatch):
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(hybrids, "PADDED_ROWS", 30)
    vectors = {r["item_id"]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in items.collect()}
    table, wanted = slates(spark), []
    for case in range(9):
        own = [(r["rank"], r["item_id"]) for r in table.where(F.col("case_id") == case).collect()]
        wanted += [(level, case, i, x) for level in (0.3, 0.8) for i, x in enumerate(walked(own, vectors, level, 6), 1)]
    found = hybrids.diversity_filter(table, items, (0.3, 0.8), 6)
    assert rows(found) == sorted(wanted)


def test_diversity_moves_no_vectors_and_no_pandas_groups(spark, items):
    found = plan(hybrids.diversity_filter(slates(spark), items, (0.3,), 6))
    assert found.count("Exchange") == 1 and "FlatMapGroupsInPandas" not in found and "embedding" not in found


def named(spark, prompts, items):
    names = items.select("item_id", F.concat(F.lit("n"), F.col("item_id").cast("string")).alias("name"))
    vectors = names.join(items, "item_id").select(F.concat(F.lit("the "), "name").alias("name"), F.col("embedding").alias("vector"))
    vectors = vectors.unionByName(names.join(items, "item_id").select("name", F.col("embedding").alias("vector")))
    name = F.concat(F.when(F.col("pos") % 3 == 0, "the n").otherwise("n"), F.col("item_id").cast("string"))
    return names, vectors, prompts.select("case_id", F.lit(0).alias("candidate"), F.col("pos").cast("int").alias("rank"), name.alias("name"))


@pytest.mark.parametrize("twice", [False, True])
def test_completion_walks_equal_joined_lists(spark, prompts, items, twice, small_batches, monkeypatch):
    names, vectors, answers = named(spark, prompts, items)
    if twice:  # two answers share a rank
        answers = answers.withColumn("rank", F.greatest(F.lit(1), F.col("rank") - 1))
    shown = prompts.select("case_id", (F.col("item_id") + 1).alias("item_id"))

    def results():
        return (rows(completions.fill_unmatched(completions.matched(answers, names), vectors, items, 3).fillna(-1)),
                rows(completions.replace_repeats(completions.answer_counts(answers), names, vectors, items, shown, 3)))

    found = results()
    monkeypatch.setattr(completions, "NEAR_ROWS", -1)  # lists are joined to the answers
    joined = results()
    if not twice:
        assert found == joined
    else:  # among answers that share a place the joined lists have no fixed order
        assert [len(x) for x in found] == [len(x) for x in joined]


def test_near_lists_are_not_joined_to_answers(spark, prompts, items):
    names, vectors, answers = named(spark, prompts, items)
    found = plan(completions.fill_unmatched(completions.matched(answers, names), vectors, items, 3))
    assert "FlatMapGroupsInPandas" not in found and "near_id" not in found


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(8)
    cells = [(s, p + 1, int(rng.integers(0, 43)), float(s), 1.0) for s in range(25) for p in range(2 + s % 9)]
    return spark.createDataFrame(cells, "session_id long, pos long, item_id long, ts double, reward double").cache()


@pytest.mark.parametrize("strategy, decay, similarity", [("mean", "harmonic", "cosine"), ("last", None, "dot"), ("concat", "harmonic", "cosine")])
def test_held_vectors_give_the_same_neighbours(spark, prompts, items, log, strategy, decay, similarity, monkeypatch):
    options = neighbours.NeighbourOptions(k=5, sample_size=8, sampling="recent", use_item_embeddings=True, prompt_strategy=strategy,
                                          train_strategy=strategy, decay=decay, similarity=similarity, train_decay="linear" if strategy == "mean" else None)
    found = neighbours.recommend_neighbours(prompts, log, 6, options, items)
    assert "array<double>" not in plan(found)  # vectors of sessions are not moved
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    wanted = neighbours.recommend_neighbours(prompts, log, 6, options, items)
    one, other = rows(found), rows(wanted)
    assert one and [r[:4] for r in one] == [r[:4] for r in other]
    assert np.allclose([r[4] for r in one], [r[4] for r in other])


def test_followers_are_looked_up_before_votes_are_summed(spark, prompts, log, monkeypatch):
    options = neighbours.NeighbourOptions(k=5, sample_size=8, sampling="recent", sequential_filter=True, idf_weighting=True)
    found = neighbours.recommend_neighbours(prompts, log, 6, options)
    assert "array_contains(_next" in plan(found)
    monkeypatch.setattr(neighbours, "FOLLOWERS", -1)  # followers are joined to the summed votes
    assert rows(found) == rows(neighbours.recommend_neighbours(prompts, log, 6, options)) != []
