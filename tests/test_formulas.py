"""Hand-computed values of decays, measures, metrics and sequence tables."""

import math

import pytest
from pyspark.sql import functions as F

from slatewright.functions import sequences as S
from slatewright.functions import text as X
from slatewright.functions.decay import decay_weight
from slatewright.functions.similarity import measure
from slatewright.operators import evaluation as E
from slatewright.operators import sequences as Q


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize("name,n,expected", [
    ("harmonic", 3, [1 / 3, 1 / 2, 1]), ("constant_linear", 3, [0.8, 0.9, 1.0]),
    ("scaling_linear", 4, [0.25, 0.5, 0.75, 1.0]), ("harmonic_squared", 2, [0.25, 1.0]),
    ("quadratic", 2, [0.25, 1.0]), (None, 2, [1.0, 1.0])])
def test_decays(spark, name, n, expected):
    rows = spark.range(1, n + 1).withColumnRenamed("id", "pos").orderBy("pos")
    got = column(rows.select(decay_weight(name, F.col("pos"), F.lit(n)).alias("w")), "w")
    assert got == pytest.approx(expected)


def test_set_measures(spark):
    one = spark.range(1).select(*[
        measure(m, F.lit(2), F.lit(3), F.lit(3), F.lit(10)).alias(m) for m in ("jaccard", "simpson")])
    row = one.first()
    assert row["jaccard"] == pytest.approx(0.5) and row["simpson"] == pytest.approx(2 / 3)


def slates(spark, rows):
    return spark.createDataFrame([("m", c, r, i) for c, r, i in rows],
                                 "model string, case_id long, rank int, item_id long")


def truths(spark, rows):
    return spark.createDataFrame(rows, "case_id long, item_id long")


def test_ranking_metrics(spark):
    recs = slates(spark, [(c, r, i) for c in (1, 2) for r, i in ((1, 7), (2, 8), (3, 9))])
    out = {r["case_id"]: r for r in E.per_case(
        recs, truths(spark, [(1, 9), (2, 7), (2, 9)]), (3,)).collect()}
    assert out[1]["NDCG"] == pytest.approx(0.5)
    assert out[2]["NDCG"] == pytest.approx(1.5 / (1 + 1 / math.log2(3)))
    assert out[2]["MRR"] == pytest.approx(2 / 3)
    assert out[1]["HitRate"] == 1.0


def test_empty_slates_count_and_missing_cases_do_not(spark):
    recs = slates(spark, [(1, 1, 7)])
    cases = spark.createDataFrame([("m", 1), ("m", 2)], "model string, case_id long")
    true = truths(spark, [(1, 7), (2, 7), (3, 7)])
    with_empty = E.evaluate(recs, true, (5,), ("HitRate",), cases=cases).first()["value"]
    without = E.evaluate(recs, true, (5,), ("HitRate",)).first()["value"]
    assert with_empty == pytest.approx(0.5) and without == pytest.approx(1.0)


def test_cut_happens_before_deduplication(spark):
    recs = slates(spark, [(1, 1, 7), (1, 2, 7), (1, 3, 9)])
    row = E.per_case(recs, truths(spark, [(1, 9)]), (2, 3)).orderBy("top_k").collect()
    assert row[0]["HitRate"] == 0.0 and row[1]["MRR"] == pytest.approx(0.5)


def test_serendipity_and_novelty(spark):
    counts = spark.createDataFrame([(1, 6), (2, 2)], "item_id long, count long")
    recs = slates(spark, [(1, 1, 5), (1, 2, 6)])
    got = E.per_case(recs, truths(spark, [(1, 1), (1, 5)]), (2,), ("Serendipity",),
                     item_counts=counts).first()
    assert got["Serendipity"] == pytest.approx(1.0)
    recs = slates(spark, [(1, 1, 2), (1, 2, 99)])
    got = E.per_case(recs, truths(spark, [(1, 2)]), (2,), ("Novelty",), item_counts=counts).first()
    assert got["Novelty"] == pytest.approx(1.0)


def test_metric_inputs_are_checked():
    with pytest.raises(ValueError):
        E.check_inputs(("Novelty",))
    with pytest.raises(ValueError):
        E.metric_group("none")


def test_cloze_masks_last_place(spark):
    rows = spark.createDataFrame([(1, i, i) for i in (1, 2, 3, 4)], "case_id long, pos long, item_id long")
    got = Q.cloze_rows(rows, 4, F.lit(99).cast("long"), 0.0, 1, copies=0).first()
    assert got["input"] == [1, 2, 3, 99] and got["target"] == [-1, -1, -1, 4]


def test_sequences_are_padded_and_shifted(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, -1), (1, 3, 6)], "case_id long, pos long, item_id long")
    assert Q.sequence_table(rows, 4).first()["sequence"] == [-1, -1, 5, 6]
    got = Q.next_item_rows(rows, 2).first()
    assert got["input"] == [-1, 5] and got["target"] == [-1, 6]


def test_multi_hot(spark):
    rows = spark.createDataFrame([(0, 1), (0, 3), (1, 0), (1, 0)], "case_id long, item_id long")
    got = {(r["case_id"], r["item_id"]): r["n"] for r in Q.multi_hot(rows, 4).collect()}
    assert got == {(0, 1): 1, (0, 3): 1, (1, 0): 2}
    with pytest.raises(Exception):
        Q.multi_hot(rows, 2).collect()


def test_last_items_of_short_lists(spark):
    one = spark.range(1).select(S.last_items(F.array(F.lit(1), F.lit(2)), 5).alias("x"))
    assert one.first()["x"] == [1, 2]


@pytest.mark.parametrize("text,expected", [
    ("x BEGIN y END BEGIN\n1. a\n2. b\nEND z", ["a", "b"]),
    ("1. a\n2. b\n3. cut", ["a", "b"]),
    ("a\n\nb", ["a", "b"]),
    (X.LIST_PREAMBLE + "\n1. a\n", ["a"])])
def test_list_completions(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.parse_delimited(F.col("t"), 20).alias("x")).first()["x"] == expected
