"""Cleaning, cases, completions, reduction, storage and the online job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewright.operators import cases, cleaning, completions as C, hybrids as H, reduction
from slatewright.operators import splitting
from slatewright.sources import readers, writers
from slatewright.streaming import online


def log_of(spark, sessions):
    rows = [(s, i, p + 1) for s, items in sessions.items() for p, i in enumerate(items)]
    return spark.createDataFrame(rows, "session_id long, item_id long, pos long")


def test_k_core_is_a_fixpoint(spark):
    log = log_of(spark, {s: [(s * 7 + j * 5) % 23 for j in range(3 + s % 5)] for s in range(40)})
    core = cleaning.k_core(log, 4)
    for key in ("session_id", "item_id"):
        assert core.groupBy(key).count().where("count < 4").isEmpty()
    assert core.count() > 0


def test_prompts_and_truths_make_up_the_session(spark):
    log = log_of(spark, {1: [4, 5, 6], 2: [7]})
    assert cases.as_arrays(cases.prompts(log)).first().asDict() == {"case_id": 1, "items": [4, 5]}
    assert [r["item_id"] for r in cases.ground_truths(log).collect()] == [6]


def test_evolving_case_ids(spark):
    log = log_of(spark, {3: [1, 2, 3, 4], 10: [5, 6]})
    found = {r["case_id"]: r["items"] for r in cases.as_arrays(cases.evolving_prompts(log)).collect()}
    assert found[2 * 2 * 10 + 3 + 1] == [1, 2, 3] and found[4] == [1]
    recent = {r["case_id"]: r["items"] for r in cases.as_arrays(
        cases.evolving_prompts(log, last_items=2)).collect()}
    assert recent[44] == [2, 3]


def test_forward_chaining(spark):
    binned = spark.createDataFrame([(b, b) for b in (1, 2, 3, 4)], "session_id long, bin int")
    got = {(r["fold"], r["session_id"]): r["role"] for r in splitting.chain_bins(binned, 3).collect()}
    assert got[(1, 2)] == "validation" and got[(3, 1)] == "train" and (1, 3) not in got


@pytest.mark.parametrize("options", [
    dict(strategy="other"), dict(test_frac=None), dict(test_frac=1.5), dict(n_withheld=0),
    dict(strategy="random", test_frac=None, test_cutoff="2024-01-01")])
def test_split_options_are_checked(options):
    with pytest.raises(ValueError):
        splitting.SplitOptions(**options)


def recs(spark, slate, case=1, scores=None):
    scores = scores or [1.0] * len(slate)
    return spark.createDataFrame([(case, r + 1, i, s) for r, (i, s) in enumerate(zip(slate, scores))],
                                 "case_id long, rank int, item_id long, score double")


def ranked(df):
    return [r["item_id"] for r in df.orderBy("rank").collect()]


def test_rank_and_confidence_ensembles(spark):
    one, two = recs(spark, [1, 2]), recs(spark, [3, 1, 4])
    assert ranked(H.rank_ensemble(one, two, (1,), 3)) == [1, 3, 4]
    sure = recs(spark, [1, 2, 3], scores=[0.9, 0.7, 0.85])
    assert ranked(H.confident_prefix(sure, (0.8,))) == [1]


def test_popularity_filter_drops_best_ranked_first(spark):
    popularity = spark.createDataFrame([(1, .1), (2, .9), (3, .1), (4, .9)], "item_id long, popularity double")
    cut = spark.createDataFrame([(0.5, 0.5)], "quantile double, cutoff double")
    assert ranked(H.popularity_filter(recs(spark, [1, 2, 3, 4]), popularity, cut, 3)) == [2, 3, 4]


def test_replaced_repeats_by_brute_force(spark):
    vectors = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.8, 0.2], 4: [0.0, 1.0], 5: [0.7, 0.3]}
    items = spark.createDataFrame([(i, v) for i, v in vectors.items()], "item_id long, embedding array<double>")
    names = spark.createDataFrame([(i, f"n{i}") for i in vectors], "item_id long, name string")
    name_vectors = spark.createDataFrame([(f"n{i}", v) for i, v in vectors.items()] + [("odd", [0.0, 1.0])],
                                         "name string, vector array<double>")
    answers = spark.createDataFrame([(9, c, 1, n) for c, n in enumerate(["n1", "n1", "n1", "odd"])],
                                    "case_id long, candidate int, rank int, name string")
    prompts = spark.createDataFrame([(9, 2)], "case_id long, item_id long")
    out = C.replace_repeats(C.answer_counts(answers), names, name_vectors, items, prompts, 5)
    # n1 stays, two neighbours of n1 that are not shown (3, 5), one of "odd" (4).
    assert ranked(out) == [1, 3, 5, 4]


def test_literal_lines_are_parsed_and_rejected(spark):
    lines = spark.createDataFrame([("{'a': 'x'}",), ("{u'a': u'y'}",), ("{'a': __import__('os')}",)], "value string")
    good, bad = readers.parse_literals(lines, "a string")
    assert sorted(r["a"] for r in good.collect()) == ["x", "y"] and bad.count() == 1


@pytest.mark.parametrize("method", reduction.METHODS)
def test_reductions(spark, method):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 120)
    x = rng.normal(size=(120, 8)) + 3 * np.eye(8)[y]
    items = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))],
                                  "item_id long, embedding array<double>, class int")
    out = np.array([r["embedding"] for r in reduction.reduce_embeddings(items, method, 3).orderBy("item_id").collect()])
    assert out.shape == (120, 3)
    if method == "pca":
        centred = x - x.mean(0)
        u, s, _ = np.linalg.svd(centred, full_matrices=False)
        ref = u[:, :3] * s[:3]
        far = lambda a: np.linalg.norm(a[:, None] - a[None], axis=2)
        assert far(out) == pytest.approx(far(ref), abs=1e-8)
    if method == "lda":
        means = np.array([out[y == c].mean(0) for c in range(4)])
        within = np.mean([out[y == c].var(0) for c in range(4)], axis=0)
        assert within == pytest.approx(np.ones(3), rel=0.2)
        assert np.linalg.norm(means[0] - means[1]) > 2


def test_bundle_round_trip(spark, tmp_path):
    log = log_of(spark, {1: [1, 2], 2: [3]})
    writers.write_bundle({"log": log, "train": log.limit(1)}, str(tmp_path), spark)
    assert writers.read_bundle(spark, str(tmp_path))["log"].count() == 3


def test_sessions_and_recommendations_round_trip(spark, tmp_path):
    log = spark.sql("SELECT 1L session_id, 2L item_id, timestamp_ntz'2024-01-02 03:04:05.678' ts, 1.0D reward")
    writers.write_sessions(log, f"{tmp_path}/s", "csv")
    assert readers.read_sessions(spark, f"{tmp_path}/s").collect() == log.collect()
    slate = recs(spark, [5, 6]).withColumn("model", F.lit("m"))
    writers.write_recommendations(slate, f"{tmp_path}/r", {"k": 2}, "run1")
    back = readers.read_recommendations(spark, f"{tmp_path}/r")
    assert {(r["model"], r["run_ts"]) for r in back.collect()} == {("m", "run1")}


def test_online_prompts_over_batches(spark, tmp_path):
    clicks = [(1, 10 + i, f"2024-01-01 00:{i:02d}:00", i) for i in range(6)] + \
             [(1, 90, "2024-01-01 09:00:00", 99), (2, 50, "2024-01-01 00:01:00", 7)]
    schema = "session_id long, item_id long, ts string, order_id long"
    parts = [clicks[:3] + clicks[7:], clicks[3:6], clicks[6:7]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1) \
            .write.mode("append").parquet(f"{tmp_path}/in")
    stream = online.click_stream(spark, f"{tmp_path}/in",
                                 "session_id long, item_id long, ts timestamp, order_id long", "*.parquet", 1)
    out = online.running_prompts(stream, 4, 3600, "12 hours")
    seen = []
    query = out.writeStream.foreachBatch(
        lambda df, n: seen.extend(df.where("not closed").collect())).option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    prompts = [r["items"] for r in seen if r["case_id"] == 1]
    assert prompts[-1] == [90] and [12, 13, 14, 15] in prompts
