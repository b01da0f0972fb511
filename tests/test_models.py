"""Models, hybrids and re-rankers behind one interface."""

from slatewright.operators import splitting
from slatewright.plans.models import Diverse, Ensemble, Popular, Reranked, Similar, run_folds, run_models
from slatewright.plans.prepared import load_and_split


def log_of(spark):
    rows = [(s, (s * 3 + j * 2) % 12, f"2024-01-{1 + s % 28:02d} 00:00:{j:02d}", 1.0, j + 1) for s in range(60) for j in range(5)]
    log = spark.createDataFrame(rows, "session_id long, item_id long, ts string, reward double, pos long")
    return log.withColumn("ts", log.ts.cast("timestamp_ntz"))


def items_of(spark):
    return spark.createDataFrame([(i, [float(i % 4), 1.0, float(i)]) for i in range(12)], "item_id long, embedding array<double>")


def test_hybrids_and_rerankers_run_like_models(spark):
    data = load_and_split(log_of(spark)).with_items(items_of(spark))
    models = [Popular(), Ensemble(Popular(), Similar(), r=2), Reranked(Popular("diverse"), Diverse(items_of(spark), 0.99), 10)]
    report = run_models(models, data, (3,), ("NDCG", "HitRate")).collect()
    assert {r.model for r in report} == {"popular", "ensemble", "diverse"} and len(report) == 6
    fitted = models[1].fit(data.train, data.items).recommend(data.prompts, 3)
    popular = models[0].fit(data.train).recommend(data.prompts, 3)
    first = {(r.case_id, r["rank"]): r.item_id for r in fitted.collect()}
    for r in popular.collect():
        if r["rank"] <= 2:
            assert first[r.case_id, r["rank"]] == r.item_id


def test_folds_are_whole_runs(spark):
    data = load_and_split(log_of(spark))
    folds = splitting.random_folds(data.train, 2, 1)
    reports, mean = run_folds([Popular()], data, folds, (3,), ("HitRate",))
    by_fold = {r.fold: r.value for r in reports.collect()}
    assert len(by_fold) == 2
    assert abs(mean.first().value - sum(by_fold.values()) / 2) < 1e-9
