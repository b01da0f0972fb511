"""Offline evaluation of recommendation slates.

A slate is cut to k first and de-duplicated after, so repeated items shorten it.
Cases without any slate are left out; cases listed in ``cases`` with an empty slate
count with 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewright.operators.draws import negative_samples
from slatewright.operators.metrics import Metric, check, measured
from slatewright.operators.popularity import popular_array
from slatewright.operators.ranking import rank_overall

# Metric names and groups.
RANKING = ("NDCG", "HitRate", "MRR")
BEYOND_ACCURACY = ("Catalog coverage", "Serendipity", "Novelty")
ALL_METRICS = RANKING + BEYOND_ACCURACY
DEFAULT_METRICS = RANKING + ("Catalog coverage",)
GROUPS = {"default": DEFAULT_METRICS, "ranking": RANKING,
          "beyond_accuracy": BEYOND_ACCURACY, "all": ALL_METRICS}
NEEDS = {"Catalog coverage": ("n_items",), "Serendipity": ("item_counts",),
         "Novelty": ("item_counts",)}


def metric_group(name: str) -> tuple[str, ...]:
    if name not in GROUPS:
        raise ValueError(f"unknown metric group {name!r}; choose one of {sorted(GROUPS)}")
    return GROUPS[name]


def check_inputs(metrics: Sequence[str | Metric], item_counts=None, n_items=None) -> None:
    """Every metric's required input must be there."""
    given = {"item_counts": item_counts is not None, "n_items": n_items is not None}
    names = [m.name if isinstance(m, Metric) else m for m in metrics]
    if len(set(names)) < len(names):
        raise ValueError(f"metrics share a name: {names}")
    for name in metrics:
        if isinstance(name, Metric):
            check(name, given)
            continue
        if name not in ALL_METRICS:
            raise ValueError(f"unknown metric {name!r}")
        for need in NEEDS.get(name, ()):
            if not given[need]:
                raise ValueError(f"metric {name} needs {need}")


def aligned_slates(recs: DataFrame, truths: DataFrame, top_ks: Sequence[int],
                   keys: Sequence[str] = ("model",), cases: DataFrame | None = None
                   ) -> DataFrame:
    """``keys, case_id, top_k, slate, truth``: cut, de-duplicated slates with truths.

    Rows are shuffled once, by case; both the grouping and the truth join use that
    partitioning.  Arrays are bounded by k and by the number of withheld items.
    """
    keys, longest = list(keys), max(top_ks)
    rows = recs.where(F.col("rank") <= longest).select(*keys, "case_id", "rank", "item_id")
    if cases is not None:
        rows = rows.unionByName(cases.select(*keys, "case_id"), allowMissingColumns=True)
    truth = truths.groupBy("case_id").agg(F.collect_list("item_id").alias("truth"))
    entry = F.when(F.col("item_id").isNotNull(), F.struct("rank", "item_id"))
    slates = rows.join(truth, "case_id").groupBy(*keys, "case_id", "truth").agg(
        F.array_sort(F.collect_list(entry)).alias("all"))
    slates = slates.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in top_ks])))
    cut = F.filter("all", lambda x: x["rank"] <= F.col("top_k"))
    return slates.select(*keys, "case_id", "top_k", "truth",
                         F.array_distinct(F.transform(cut, lambda x: x["item_id"])).alias("slate"))


def hit_positions(slate: Column, truth: Column) -> Column:
    """1-based places of relevant items in the slate."""
    places = F.transform(slate, lambda x, i: F.when(F.array_contains(truth, x), i + 1))
    return F.filter(places, lambda p: p.isNotNull())


def _total(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, p: acc + term(p))


def _ideal_dcg(n: Column, longest: int) -> Column:
    sums, total = [], 0.0
    for i in range(1, longest + 1):
        total += 1.0 / math.log2(i + 1)
        sums.append(F.lit(total))
    return F.element_at(F.array(*sums), n)


def per_case(recs: DataFrame, truths: DataFrame, top_ks: Sequence[int],
             metrics: Sequence[str] = RANKING, keys: Sequence[str] = ("model",),
             cases: DataFrame | None = None, item_counts: DataFrame | None = None,
             first_hit_mrr: bool = False) -> DataFrame:
    """One row per case and k with a column for each per-case metric.

    ``MRR`` averages 1/rank over all hits (with a single truth this is the usual
    reciprocal rank); ``first_hit_mrr`` uses the first hit only.
    """
    keys, longest = list(keys), max(top_ks)
    slates = aligned_slates(recs, truths, top_ks, keys, cases)
    found = slates.withColumn("hits", hit_positions(F.col("slate"), F.col("truth")))
    gain = _total(F.col("hits"), lambda p: F.lit(1.0) / F.log2(p + 1.0))
    ideal = _ideal_dcg(F.least(F.size("truth"), F.col("top_k")), longest)
    reciprocal = _total(F.col("hits"), lambda p: F.lit(1.0) / p) / F.size("hits")
    if first_hit_mrr:
        reciprocal = F.lit(1.0) / F.element_at("hits", 1)
    any_hit = F.size("hits") > 0
    columns = {
        "NDCG": F.when(any_hit, gain / ideal).otherwise(F.lit(0.0)),
        "HitRate": F.when(any_hit, 1.0).otherwise(0.0),
        "MRR": F.when(any_hit, reciprocal).otherwise(F.lit(0.0)),
    }
    if "Serendipity" in metrics:
        expected = F.slice(F.col("expected"), 1, F.col("top_k"))
        unexpected = F.array_except(F.col("truth"), expected)
        relevant = F.size(F.array_intersect(F.col("slate"), unexpected))
        bound = F.least(F.size(unexpected), F.size("slate"))
        columns["Serendipity"] = F.when(bound > 0, relevant / bound).otherwise(F.lit(0.0))
        found = found.withColumn("expected", popular_array(item_counts, longest))
    wanted = [m for m in metrics if m in columns]
    out = found.select(*keys, "case_id", "top_k", "slate",
                       *[columns[m].alias(m) for m in wanted])
    if "Novelty" in metrics:
        surprise = _novelty(out.select(*keys, "case_id", "top_k", "slate"), keys, item_counts)
        out = out.join(surprise, [*keys, "case_id", "top_k"], "left")
        out = out.withColumn("Novelty", F.coalesce("Novelty", F.lit(0.0)))
    return out.drop("slate")


def _novelty(slates, keys, item_counts):
    total = item_counts.agg(F.sum("count").cast("double").alias("t")).scalar()
    information = item_counts.select(
        "item_id", (-F.log2(F.col("count") / total)).alias("bits"))
    items = slates.select(*keys, "case_id", "top_k", F.explode("slate").alias("item_id"))
    return items.join(information, "item_id", "left").groupBy(*keys, "case_id", "top_k").agg(
        (F.sum(F.coalesce("bits", F.lit(0.0))) / F.count(F.lit(1))).alias("Novelty"))


def catalog_coverage(recs: DataFrame, truths: DataFrame, top_ks: Sequence[int],
                     n_items: Column | int, keys: Sequence[str] = ("model",)) -> DataFrame:
    """``keys, top_k, value``: share of the catalogue that was recommended at all.

    An item's best rank decides every k, so each item travels once per model.
    """
    keys = list(keys)
    n_items = F.lit(n_items) if isinstance(n_items, int) else n_items
    judged = recs.join(truths.select("case_id").distinct(), "case_id", "left_semi")
    best = (judged.where(F.col("rank") <= max(top_ks))
            .groupBy(*keys, "item_id").agg(F.min("rank").alias("best")))
    reached = F.filter(F.array(*[F.lit(k) for k in top_ks]), lambda k: k >= F.col("best"))
    return (best.withColumn("top_k", F.explode(reached)).groupBy(*keys, "top_k")
            .agg((F.count(F.lit(1)) / n_items).alias("value")))


def evaluate(recs: DataFrame, truths: DataFrame, top_ks: Sequence[int] = (10, 20),
             metrics: Sequence[str | Metric] = DEFAULT_METRICS, keys: Sequence[str] = ("model",),
             cases: DataFrame | None = None, item_counts: DataFrame | None = None,
             n_items: Column | int | None = None, prefix: str = "") -> DataFrame:
    """``keys, top_k, metric, value``: means over cases, catalogue coverage, and metrics of one's own (:class:`Metric`)."""
    keys = list(keys)
    check_inputs(metrics, item_counts, n_items)
    own = [m for m in metrics if isinstance(m, Metric)]
    metrics = [m for m in metrics if not isinstance(m, Metric)]
    means = [m for m in metrics if m != "Catalog coverage"]
    parts = []
    if own:
        slates = aligned_slates(recs, truths, top_ks, keys, cases).withColumn("hits", hit_positions(F.col("slate"), F.col("truth")))
        if isinstance(n_items, Column):
            n_items_here = recs.sparkSession.range(1).select(n_items.alias("n")).first()[0]
        else:
            n_items_here = n_items
        parts.append(measured(slates, keys, own, item_counts, n_items_here).withColumn("metric", F.concat(F.lit(prefix), "metric")))
    if means:
        cases_table = per_case(recs, truths, top_ks, means, keys, cases, item_counts)
        wide = cases_table.groupBy(*keys, "top_k").agg(*[F.avg(m).alias(m) for m in means])
        entries = F.array(*[F.struct(F.lit(prefix + m).alias("metric"),
                                     F.col(f"`{m}`").alias("value")) for m in means])
        parts.append(wide.select(*keys, "top_k", F.inline(entries)))
    if "Catalog coverage" in metrics:
        parts.append(catalog_coverage(recs, truths, top_ks, n_items, keys).select(
            *keys, "top_k", F.lit(prefix + "Catalog coverage").alias("metric"), "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def average_reports(reports: DataFrame, keys: Sequence[str] = ("model", "top_k", "metric")
                    ) -> DataFrame:
    """Mean of several reports (folds, trials) per model, k and metric."""
    return reports.groupBy(*keys).agg(F.avg("value").alias("value"))


def best_trial(reports: DataFrame, metric: str = "NDCG", top_k: int = 20) -> DataFrame:
    """``model, trial, value``: the trial with the highest value per model."""
    rows = reports.where((F.col("metric") == metric) & (F.col("top_k") == top_k))
    order = F.struct("value", (-F.col("trial")).alias("t"))
    return rows.groupBy("model").agg(F.max_by("trial", order).alias("trial"),
                                     F.max("value").alias("value"))


def report_table(reports: DataFrame, top_ks: Sequence[int], metrics: Sequence[str],
                 keys: Sequence[str] = ("model",)) -> DataFrame:
    """Wide table, one column ``metric@k`` for each pair."""
    labelled = reports.withColumn("_label", F.concat_ws("@", "metric", F.col("top_k").cast("string")))
    labels = [f"{m}@{k}" for k in top_ks for m in metrics]
    return labelled.groupBy(*keys).pivot("_label", labels).agg(F.first("value"))


def report_json(reports: DataFrame) -> DataFrame:
    """``model, json``: one JSON object per model, metric names in order."""
    entry = F.struct(F.concat_ws("@", "metric", F.col("top_k").cast("string")).alias("key"), "value")
    entries = F.array_sort(F.collect_list(entry))
    return reports.groupBy("model").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def flag_best(reports: DataFrame) -> DataFrame:
    """Adds ``is_best``: highest value of its metric and k over all models."""
    window = Window.partitionBy("metric", "top_k").orderBy(F.desc("value"))
    return reports.withColumn("is_best", F.rank().over(window) == 1)


def unique_model_names(reports: Sequence[DataFrame]) -> DataFrame:
    """Union of reports; a repeated model name gets a running suffix."""
    numbered = None
    for i, report in enumerate(reports):
        part = report.withColumn("_run", F.lit(i))
        numbered = part if numbered is None else numbered.unionByName(part)
    runs = numbered.select("model", "_run").distinct()
    nth = F.row_number().over(Window.partitionBy("model").orderBy("_run"))
    runs = runs.withColumn("_nth", nth)
    name = F.when(F.col("_nth") == 1, F.col("model")).otherwise(
        F.concat_ws("_", "model", (F.col("_nth") - 1).cast("string")))
    return (numbered.join(F.broadcast(runs.withColumn("_name", name)), ["model", "_run"])
            .withColumn("model", F.col("_name")).drop("_run", "_nth", "_name"))


def sorted_case_values(cases: DataFrame, metric: str) -> DataFrame:
    """``model, top_k, place, value``: per-case values, best first (data of a curve).

    Equal values share their place in the curve, so it is built from value counts; the
    table of distinct values is far smaller than the table of cases.
    """
    groups = ["model", "top_k"]
    counted = cases.groupBy(*groups, F.col(f"`{metric}`").alias("value")).agg(
        F.count(F.lit(1)).alias("n_cases"))
    ahead = Window.partitionBy(*groups).orderBy(F.desc("value")).rowsBetween(
        Window.unboundedPreceding, -1)
    return counted.select(*groups, "value", "n_cases",
                          (F.coalesce(F.sum("n_cases").over(ahead), F.lit(0)) + 1).alias("place"))


def case_curve(cases: DataFrame, metric: str) -> DataFrame:
    """``model, top_k, case_id, value, place``: every case with its own place."""
    value = F.round(F.col(f"`{metric}`"), 9)
    keyed = cases.select("model", "top_k", "case_id", value.alias("value"))
    from slatewright.operators.ranking import rank_within
    return rank_within(keyed, ["model", "top_k"], [F.desc("value"), F.col("case_id")], name="place")


def sampled_slates(recs: DataFrame, truths: DataFrame, item_counts: DataFrame, top_l: int,
                   n_negatives: int, seed: int, weighted: bool = True) -> DataFrame:
    """Top-l slates reduced to the case's own sample of negatives and the truth, ranked again."""
    negatives = negative_samples(recs, item_counts, n_negatives, seed, weighted).withColumn("_neg", F.lit(True))
    sampled = recs.where(F.col("rank") <= top_l).join(negatives, ["case_id", "item_id"], "left")
    relevant = truths.select("case_id", "item_id", F.lit(True).alias("_true")).distinct()
    kept = (sampled.join(relevant, ["case_id", "item_id"], "left")
            .where(F.col("_neg").isNotNull() | F.col("_true").isNotNull()))
    window = Window.partitionBy("model", "case_id").orderBy("rank")
    return kept.select("model", "case_id", F.row_number().over(window).alias("rank"),
                       "item_id", "score")


def sampled_evaluate(recs: DataFrame, truths: DataFrame, item_counts: DataFrame,
                     top_l: int = 100, top_k: int = 10, n_negatives: int = 100,
                     seed: int = 42, weighted: bool = True) -> DataFrame:
    """Leave-one-out ranking metrics against sampled negatives, ``sampled_`` prefixed. Each case has its own sample."""
    withheld = truths.groupBy("case_id").count().where("count > 1")
    if not withheld.isEmpty():
        raise ValueError("sampled evaluation needs exactly one truth per case")
    slates = sampled_slates(recs, truths, item_counts, top_l, n_negatives, seed, weighted)
    cases = recs.select("model", "case_id").distinct()
    return evaluate(slates, truths, (top_k,), RANKING, cases=cases, prefix="sampled_")


def hit_rate_by_length(cases: DataFrame, prompt_lengths: DataFrame, longest: int = 20
                       ) -> DataFrame:
    """``model, top_k, length, hit_rate, n_cases`` for prompts of up to 20 items."""
    joined = cases.join(prompt_lengths.where(F.col("length") <= longest), "case_id")
    return joined.groupBy("model", "top_k", "length").agg(
        F.avg("HitRate").alias("hit_rate"), F.count(F.lit(1)).alias("n_cases"))


def slate_overlap(recs: DataFrame, truths: DataFrame, top_k: int) -> DataFrame:
    """``model_1, model_2, common_share, common_correct_share`` for ordered model pairs.

    All models that recommend an item for a case are gathered in one short array (one
    entry per model), so pairs of models are formed per item and case, not per row pair.
    """
    rows = recs.where(F.col("rank") <= top_k).select("model", "case_id", "item_id").distinct()
    correct = truths.select("case_id", "item_id", F.lit(1).alias("hit")).distinct()
    marked = rows.join(correct, ["case_id", "item_id"], "left")
    shared = marked.groupBy("case_id", "item_id").agg(
        F.collect_set("model").alias("models"), F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    pairs = (shared.withColumn("model_1", F.explode("models"))
             .withColumn("model_2", F.explode("models"))
             .groupBy("model_1", "model_2")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("n_hit")))
    own = pairs.where("model_1 = model_2").select(
        "model_1", F.col("n").alias("own"), F.col("n_hit").alias("own_hit"))
    return (pairs.join(F.broadcast(own), "model_1").where("model_1 <> model_2").select(
        "model_1", "model_2", (F.col("n") / F.col("own")).alias("common_share"),
        F.when(F.col("own_hit") > 0, F.col("n_hit") / F.col("own_hit"))
        .alias("common_correct_share")))


def unique_item_count(slates: DataFrame, truths: DataFrame) -> DataFrame:
    """One row ``n_items``: distinct items over slates and truths."""
    both = slates.select("item_id").unionByName(truths.select("item_id"))
    return both.distinct().agg(F.count(F.lit(1)).alias("n_items"))
