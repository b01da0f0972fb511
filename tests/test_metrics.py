"""Metrics of one's own through ``evaluate``, against plain loops."""

from __future__ import annotations

import random
import statistics

import pytest

from slatewright.operators import evaluation as E
from slatewright.operators.metrics import Metric


def own_classes():
    """Classes of a function go to the tasks by value, as those of a script do."""

    class MedianRank(Metric):
        name = "median rank"

        def case(self, case):
            return min(case.hits) if case.hits else None

        def start(self):
            return []

        def update(self, state, value):
            return state if value is None else [*state, value]

        def merge(self, state, other):
            return sorted([*state, *other])

        def finalise(self, state):
            return statistics.median_low(state) if state else None

    class MeanCount(Metric):
        name, needs = "mean count", ("item_counts", "n_items")

        def case(self, case):
            assert len(case.counts) == len(case.slate)
            return sum(case.counts) / case.n_items

    return MedianRank, MeanCount


MedianRank, MeanCount = own_classes()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    slates = {(m, c): rng.sample(range(30), rng.randrange(1, 12)) for m in ("a", "b") for c in range(90)}
    truth = {c: rng.sample(range(30), rng.randrange(1, 3)) for c in range(80)}
    recs = spark.createDataFrame([(m, c, r + 1, x, 1.0) for (m, c), s in slates.items() for r, x in enumerate(s)],
                                 "model string, case_id long, rank int, item_id long, score double").repartition(5)
    truths = spark.createDataFrame([(c, p + 1, x) for c, t in truth.items() for p, x in enumerate(t)], "case_id long, pos long, item_id long")
    counts = spark.createDataFrame([(i, i * i) for i in range(25)], "item_id long, count long")
    return slates, truth, recs, truths, counts


def test_own_metrics_beside_named_ones(tables):
    slates, truth, recs, truths, counts = tables
    report = E.evaluate(recs, truths, (3, 10), ("HitRate", MedianRank(), MeanCount()), item_counts=counts, n_items=25, prefix="x_")
    got = {(r.model, r.top_k, r.metric): r.value for r in report.collect()}
    assert len(got) == 2 * 2 * 3
    for m in ("a", "b"):
        for k in (3, 10):
            judged = [(slates[m, c][:k], t) for c, t in truth.items()]
            firsts = [min(s.index(x) + 1 for x in t if x in s) for s, t in judged if set(s) & set(t)]
            assert got[m, k, "x_median rank"] == statistics.median_low(firsts)
            assert got[m, k, "x_HitRate"] == pytest.approx(len(firsts) / len(judged))
            sums = [sum(x * x if x < 25 else 0 for x in s) / 25 for s, _ in judged]
            assert got[m, k, "x_mean count"] == pytest.approx(sum(sums) / len(sums))


def test_no_hits_give_no_median(tables, spark):
    _, _, recs, truths, _ = tables
    nothing = truths.selectExpr("case_id", "pos", "item_id + 1000 AS item_id")
    assert {r.value for r in E.evaluate(recs, nothing, (5,), (MedianRank(),)).collect()} == {None}


def test_needs_and_names_are_checked(tables):
    _, _, recs, truths, counts = tables
    with pytest.raises(ValueError, match="needs n_items"):
        E.evaluate(recs, truths, (5,), (MeanCount(),), item_counts=counts)
    with pytest.raises(ValueError, match="share a name"):
        E.evaluate(recs, truths, (5,), (MedianRank(), MedianRank()))

    class Nameless(MedianRank):
        name = ""

    with pytest.raises(ValueError, match="no name"):
        E.evaluate(recs, truths, (5,), (Nameless(),))
