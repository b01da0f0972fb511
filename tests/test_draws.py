"""Draws per case: their laws, their independence, and the stored index they read."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slatewright.operators import draws, neighbours as N
from slatewright.operators.index import NeighbourIndex
from slatewright.operators.ranking import running_total
from slatewright.plans.models import Neighbours


@pytest.fixture(scope="module")
def log(spark):
    """Item 1 in all of 60 sessions, item 2 in a half, item 3 in every tenth; the rest is noise."""
    rng, rows = random.Random(1), []
    for s in range(60):
        items = [1] + [2] * (s % 2) + [3] * (s % 10 == 0) + rng.sample(range(10, 40), 3)
        rows += [(s, x, f"2024-01-01 00:{s:02d}:00", 1.0, p + 1) for p, x in enumerate(items)]
    df = spark.createDataFrame(rows, "session_id long, item_id long, ts string, reward double, pos long")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


def sample(spark, index, options, prompt, n_cases):
    prompts = spark.createDataFrame([(c, p + 1, x) for c in range(n_cases) for p, x in enumerate(prompt)],
                                    "case_id long, pos long, item_id long")
    items = N.prompt_vectors(N.normalised_prompts(prompts, index.items), None)
    return N.sampled_pairs(items, index, options).collect()


@pytest.mark.parametrize("factor", [1, 1000])
def test_random_sample_is_uniform_and_own(spark, log, factor):
    """By draws and by whole lists alike: equal prompts, different samples, every session equally often."""
    index, cases, size = NeighbourIndex.of(log), 600, 6
    options = N.NeighbourOptions(k=5, sample_size=size, draw_factor=factor)
    rows = sample(spark, index, options, [1, 2, 3], cases)
    found = Counter(r.session_id for r in rows)
    per_case = {}
    for r in rows:
        per_case.setdefault(r.case_id, []).append(r.session_id)
    assert all(len(x) == len(set(x)) == size for x in per_case.values()) and len({tuple(sorted(x)) for x in per_case.values()}) > 590
    mean = cases * size / 60
    assert set(found) == set(range(60))
    # sessions that share one, two or three items are equally likely; 5 standard deviations
    assert all(abs(n - mean) < 5 * mean ** 0.5 for n in found.values())
    chi = sum((n - mean) ** 2 / mean for n in found.values())
    assert chi < 60 + 5 * (2 * 60) ** 0.5


def test_random_sample_of_all(spark, log):
    """A sample that holds nearly all candidates runs out of draws and reads the rest."""
    index = NeighbourIndex.of(log)
    for size in (55, 60, 80):
        rows = sample(spark, index, N.NeighbourOptions(k=5, sample_size=size, draw_factor=1), [1, 2, 3], 20)
        assert Counter(r.case_id for r in rows) == {c: min(size, 60) for c in range(20)}
        assert len({(r.case_id, r.session_id) for r in rows}) == len(rows)


def test_greedy_fills_from_the_overfull_item(spark, log):
    index, cases = NeighbourIndex.of(log), 400
    rows = sample(spark, index, N.NeighbourOptions(k=5, sample_size=12, sampling="idf_greedy", draw_factor=1), [1, 2, 3], cases)
    per_case = {}
    for r in rows:
        per_case.setdefault(r.case_id, []).append(r.session_id)
    third = {s for s in range(60) if s % 10 == 0}
    assert all(third <= set(x) and len(x) == 12 for x in per_case.values())
    # item 2 is rarer than item 1 and overfills: its 30 sessions are all odd, so none holds item 3
    fill = Counter(s for x in per_case.values() for s in x if s not in third)
    mean = cases * 6 / 30
    assert set(fill) == {s for s in range(60) if s % 2} and all(abs(n - mean) < 5 * mean ** 0.5 for n in fill.values())


def test_greedy_reads_the_rest_of_a_list_once(spark, log):
    """The overfull item's list is nearly wholly shared with rarer items, so draws run out."""
    index = NeighbourIndex.of(log)
    for size in (14, 20, 29):
        rows = sample(spark, index, N.NeighbourOptions(k=5, sample_size=size, sampling="idf_greedy", draw_factor=1), [1, 2, 3, *range(10, 40)], 12)
        assert Counter(r.case_id for r in rows) == {c: size for c in range(12)}
        assert len({(r.case_id, r.session_id) for r in rows}) == len(rows)


def test_overlaps_of_drawn_pairs_are_whole(spark, log):
    index = NeighbourIndex.of(log)
    cells = {(r.session_id, r.item_id) for r in log.collect()}
    for sampling in N.SAMPLINGS:
        for r in sample(spark, index, N.NeighbourOptions(k=5, sample_size=9, sampling=sampling, draw_factor=1, hot_df=20), [1, 2, 3, 11], 5):
            shared = [p for p, x in enumerate([1, 2, 3, 11], 1) if (r.session_id, x) in cells]
            assert (r.both, r.last_pos, r.n) == (len(shared), max(shared), 4)


def law(weights: list[int], n: int) -> dict[frozenset, float]:
    """Exact chances of the sets drawn one after the other without replacement."""
    out: Counter = Counter()
    for order in itertools.permutations(range(len(weights)), n):
        p, left = 1.0, sum(weights)
        for i in order:
            p, left = p * weights[i] / left, left - weights[i]
        out[frozenset(order)] += p
    return out


@pytest.mark.parametrize("race", [True, False])
def test_negative_samples_follow_their_law(spark, monkeypatch, race):
    if not race:
        monkeypatch.setattr(draws, "RACE_FACTOR", 0)
    weights, n, cases = [50, 20, 10, 5, 1], 2, 6000
    counts = spark.createDataFrame([(i, w) for i, w in enumerate(weights)] + [(9, 0)], "item_id long, count long")
    rows = draws.negative_samples(spark.range(cases).withColumnRenamed("id", "case_id"), counts, n, 3).collect()
    sets = {}
    for r in rows:
        sets.setdefault(r.case_id, set()).add(r.item_id)
    found = Counter(frozenset(x) for x in sets.values())
    assert len(sets) == cases
    for chosen, p in law(weights, n).items():
        assert abs(found[chosen] - cases * p) < 5 * (cases * p) ** 0.5 + 3


def test_uniform_negatives_and_heavy_items(spark):
    counts = spark.createDataFrame([(i, 10 ** 9 if i == 7 else 1 + i % 3) for i in range(2000)], "item_id long, count long")
    cases = spark.range(300).withColumnRenamed("id", "case_id")
    rows = draws.negative_samples(cases, counts, 20, 5, weighted=False).collect()
    found = Counter(r.item_id for r in rows)
    assert len(rows) == 6000 and max(found.values()) < 20 and len(found) > 1800
    assert {r.case_id for r in rows if r.item_id == 7} != set(range(300))


def test_line_of_items_covers_every_point_once(spark):
    weights = [1, 1, 90_000, 1, 7, 1]
    items = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "item_id long, w long")
    line, total, width = draws.line_of_items(items, "w")
    points = spark.range(total).withColumn("_bucket", F.floor(F.col("id") / width)).join(line, "_bucket").where("id >= lo AND id < hi")
    assert {r.item_id: r["count"] for r in points.groupBy("item_id").count().collect()} == dict(enumerate(weights))


def test_running_total(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("w")).repartition(5)
    got = {r.id: r.before for r in running_total(df, [F.col("id")], "w").collect()}
    assert got == {i: sum(j % 7 for j in range(i)) for i in range(1000)}


def test_stored_index_reads_no_log(spark, log, tmp_path):
    options = N.NeighbourOptions(k=5, sample_size=9, decay="harmonic", sequential_filter=True)
    train, prompts = log.where("session_id >= 20"), log.where("session_id < 20").select(F.col("session_id").alias("case_id"), "pos", "item_id")
    want = sorted(map(tuple, N.recommend_neighbours(prompts, train, 10, options).collect()))
    model = Neighbours(options, path=str(tmp_path / "index")).fit(train)
    again = Neighbours(options, path=str(tmp_path / "index")).load(spark)
    for m in (model, again):
        assert sorted(map(tuple, m.recommend(prompts, 10).collect())) == want
    # the sessions of an item, and the items of a session, are met where they lie
    plan = again.index.postings.join(spark.createDataFrame([(1,)], "item_id long").hint("merge"), "item_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_draws_are_not_broadcast(spark, log):
    """The draws of a case are judged by their own number, not by the one row they were made from."""
    waiting = spark.range(20).select(F.col("id").alias("case_id"), F.lit(30).cast("long").alias("_total")).repartition(2)
    spans = spark.range(2000).selectExpr("id % 20 AS case_id", "id AS item_id", "floor(id / 20) AS lo", "1L AS df")
    drawn = draws.drawn_places(waiting, spans, "case_id", "_total", "df", 1, 0, 500)
    assert drawn.count() == 20 * 500
    assert "Broadcast" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_hot_samples_are_as_large_as_the_others():
    from slatewright.plans.registry import neighbours as registered
    for sampling in N.SAMPLINGS:
        assert "sample_rank <= 50)" in registered.SQL[f"neighbour_sample_hot_{sampling}_k8"]
