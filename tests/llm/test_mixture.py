"""Sharding and mixing."""

from collections import Counter

import pytest

from slatewright.llm import mixing, queries, sharding

CLASH = "doc_id long, text string, source string, rate double, shard int, _copies int"


def rows(n=300):
    return [(i, None if i == 3 else "t" * (i % 7), None if i % 50 == 0 else f"s{(i % 3) // 2}", 0.5, 7, 1) for i in range(n)]


def test_shards_match_the_mixture(spark):
    listed = rows() + [rows()[5]] * 3
    docs = spark.createDataFrame(listed, CLASH).repartition(7)
    got = sharding.assign_shards(docs, shards=7).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in listed)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    for source in {r.source for r in got}:
        share = Counter(r.shard for r in got if r.source == source)
        assert max(share.values()) - min(share.get(s, 0) for s in sizes) <= 2
    again = sharding.assign_shards(docs.repartition(3), shards=7).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_written_shards_hold_all_rows(spark, tmp_path):
    listed = rows(90) + [rows()[5]] * 3 + [(5, "other", "s1", 0.1, 2, 1), (None, "x", None, 0.2, 3, 1), (None, "x", None, 0.3, 4, 1)] + [
        (None, None, "s0", 0.5, 7, 1)] * 2
    docs = spark.createDataFrame(listed, CLASH).drop("_copies").repartition(5)
    sharding.write_shards(docs, f"{tmp_path}/shards", shards=4)
    got = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter((r.doc_id, r.text, r.source, r.rate) for r in got) == Counter(r[:4] for r in listed)
    placed = Counter((r.doc_id, r.source, r.shard, r.slot) for r in sharding.assign_shards(docs, shards=4).collect())
    assert Counter((r.doc_id, r.source, r.shard, r.slot) for r in got) == placed
    sharding.write_shards(mixing.mix(docs, target_rows=200), f"{tmp_path}/mixed", shards=4)
    mixed = Counter((r.doc_id, r.text) for r in mixing.mix(docs, target_rows=200).collect())
    assert Counter((r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/mixed").collect()) == mixed


def test_more_shards_than_rows_and_none(spark):
    docs = spark.createDataFrame(rows(3), CLASH)
    assert sorted(r.slot for r in sharding.assign_shards(docs, shards=10).collect()) == [0, 0, 0]
    assert sharding.assign_shards(docs.limit(0), shards=10).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, shards=0)


def test_mixing_meets_rates(spark):
    docs = spark.createDataFrame(rows(3000), CLASH).repartition(5)
    mixed = mixing.mix(docs, {"s0": 1.0, "s1": 3.0}, target_rows=6000)
    assert "text" in mixed.columns and "copy" in mixed.columns
    counts = Counter(r.source for r in mixed.collect())
    assert None not in counts  # weighs nothing
    assert abs(counts["s0"] - 1500) < 200 and abs(counts["s1"] - 4500) < 350
    again = mixing.mix(docs.repartition(2), {"s0": 1.0, "s1": 3.0}, target_rows=6000)
    assert Counter((r.doc_id, r.copy) for r in mixed.collect()) == Counter((r.doc_id, r.copy) for r in again.collect())


def test_rows_without_id_are_drawn_apart(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "s", 0.5, 7, 1) for i in range(400)], CLASH).select("doc_id", "text", "source")
    n = Counter(r.text for r in mixing.mix(docs, target_rows=400).collect())
    assert 300 <= sum(n.values()) <= 500 and 200 <= len(n) < 300 and max(n.values()) >= 2
    order = [int(r.text.split()[1]) for r in mixing.mix(docs, target_rows=400).collect() if r.text]
    assert order != sorted(order)


def test_query_mixes_whole_documents(spark, tmp_path, monkeypatch):
    spark.createDataFrame(rows(), CLASH).select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    seen, mix = [], mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda docs: seen.append(mix(docs)) or seen[0])
    got = queries.op6_mixing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "source", "copy", "rate"] and "text" in seen[0].columns
    written = spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0])
    assert Counter((r.doc_id, r.text, r.copy) for r in written.collect()) == Counter((r.doc_id, r.text, r.copy) for r in seen[0].collect())


def test_poisson_law(spark):
    import math

    below = spark.range(1).select(mixing.cumulative(mixing.F.lit(2.5)).alias("c")).first().c
    for k in range(10):
        assert abs(below[k] - sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(k + 1))) < 1e-12
    large = spark.range(1).select(mixing.cumulative(mixing.F.lit(2000.0)).alias("c")).first().c
    assert abs(large[-1] - 1) < 1e-9
    assert spark.range(1).select(mixing.cumulative(mixing.F.lit(0.0)).alias("c")).first().c == [1.0]


def test_mixing_edges(spark):
    docs = spark.createDataFrame(rows(50), CLASH)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, {"unknown": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": -1.0})
