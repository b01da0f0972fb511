"""Combining and re-ranking slates.

A sweep is a table of parameters: each slate row is repeated once per parameter and all
settings are computed in one job, keyed by ``param``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewright.operators.blocks import NO_ITEM, held_items, places, unit_rows
from slatewright.operators.ranking import key_starts, rerank, spread, whole_keys
from slatewright.session import cut_lineage

KEYS = ["param", "case_id"]
#: Vectors of slates, filled up to the longest, that are walked in one step.
PADDED_ROWS = 8192


def _params(values: Sequence[float]):
    return F.explode(F.array(*[F.lit(float(v)) for v in values]))


def _first_then_second(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """``param, case_id, rank, item_id``: kept first part, then the second; no repeats.

    A place number orders both parts, the smallest one of an item counts.
    """
    both = first.select(*KEYS, "item_id", F.col("rank").cast("long").alias("_place")).unionByName(
        second.select(*KEYS, "item_id", (F.col("rank") + (1 << 40)).alias("_place")))
    placed = both.groupBy(*KEYS, "item_id").agg(F.min("_place").alias("_place"))
    order = Window.partitionBy(*KEYS).orderBy("_place")
    return (placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(*KEYS, "rank", "item_id"))


def rank_ensemble(first: DataFrame, second: DataFrame, cutoffs: Sequence[int], k: int
                  ) -> DataFrame:
    """The first r items of one model, then the other model, for every r."""
    one = first.withColumn("param", _params(cutoffs)).where(F.col("rank") <= F.col("param"))
    return _first_then_second(one, second.withColumn("param", _params(cutoffs)), k)


def confident_prefix(first: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """Rows of a slate before its first score below the cut-off, per cut-off."""
    swept = first.withColumn("param", _params(cutoffs))
    low = swept.where(F.col("score") < F.col("param"))
    stop = low.groupBy(*KEYS).agg(F.min("rank").alias("_stop"))
    joined = swept.join(stop, KEYS, "left")
    return joined.where(F.col("_stop").isNull() | (F.col("rank") < F.col("_stop"))).drop("_stop")


def confidence_ensemble(first: DataFrame, second: DataFrame, cutoffs: Sequence[float], k: int
                        ) -> DataFrame:
    return _first_then_second(confident_prefix(first, cutoffs),
                              second.withColumn("param", _params(cutoffs)), k)


def prefix_lengths(first: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """``param, n_cases, mean, std, min, max``: how much of the first model is kept."""
    cases = first.select("case_id").distinct().withColumn("param", _params(cutoffs))
    kept = confident_prefix(first, cutoffs).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    lengths = cases.join(kept, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return lengths.groupBy("param").agg(
        F.count(F.lit(1)).alias("n_cases"), F.avg("n").alias("mean"), F.stddev("n").alias("std"),
        F.min("n").alias("min"), F.max("n").alias("max"))


def popularity_switch(neural: DataFrame, embedding: DataFrame, last_items: DataFrame,
                      popularity: DataFrame, cutoffs: DataFrame, k: int) -> DataFrame:
    """One model where the last prompt item is popular, the other one elsewhere.

    ``last_items`` holds ``case_id, item_id``; ``cutoffs`` holds ``quantile, cutoff``
    (a handful of rows, attached to each case as one array). An item without a known
    popularity has none, so it counts as 0.
    """
    levels = cutoffs.agg(F.collect_list(F.struct("quantile", "cutoff"))).scalar()
    known = last_items.join(popularity, "item_id", "left").select(
        "case_id", F.coalesce("popularity", F.lit(0)).alias("popularity"), F.explode(levels).alias("_l"))
    choice = known.select("case_id", F.col("_l.quantile").alias("param"),
                          (F.col("popularity") >= F.col("_l.cutoff")).alias("_popular"))
    pool = neural.select("case_id", "rank", "item_id", F.lit(True).alias("_popular")).unionByName(
        embedding.select("case_id", "rank", "item_id", F.lit(False).alias("_popular")))
    chosen = pool.join(choice, ["case_id", "_popular"])
    placed = chosen.groupBy(*KEYS, "item_id").agg(F.min("rank").alias("rank"))
    return rerank(placed, KEYS, [F.col("rank")]).where(F.col("rank") <= k).select(
        *KEYS, "rank", "item_id")


def popularity_filter(slates: DataFrame, popularity: DataFrame, cutoffs: DataFrame, k: int
                      ) -> DataFrame:
    """Drop unpopular items, best-ranked first, while the slate is longer than k.

    Items without a known popularity count as 0.
    """
    levels = cutoffs.agg(F.collect_list(F.struct("quantile", "cutoff"))).scalar()
    # by case, so that the windows below need no other shuffle where popularity is small
    unique = spread(slates.select("case_id", "item_id", "rank"), "case_id").groupBy("case_id", "item_id").agg(F.min("rank").alias("rank"))
    known = unique.join(popularity, "item_id", "left").withColumn("_l", F.explode(levels))
    low = F.coalesce("popularity", F.lit(0)) < F.col("_l.cutoff")
    rows = known.select(F.col("_l.quantile").alias("param"), "case_id", "rank", "item_id",
                        low.cast("int").alias("_low"))
    whole = Window.partitionBy(*KEYS)
    so_far = whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn(
        "_nth", F.sum("_low").over(so_far))
    kept = marked.where((F.col("_low") == 0) | (F.col("_nth") > F.col("_n") - k))
    return rerank(kept, KEYS, [F.col("rank")]).where(F.col("rank") <= k).select(
        *KEYS, "rank", "item_id")


def diversity_filter(slates: DataFrame, items: DataFrame, thresholds: Sequence[float], k: int,
                     keys: Sequence[str] = ("case_id",), together: bool = False) -> DataFrame:
    """``param, keys, rank, item_id``: keep an item if it differs from all kept ones.

    Walks each slate from the top; the first item always stays. Slates pass as sorted rows, many in one step, and
    similarities are computed inside a slate only. Item vectors that fit a task are sent to it once, others come with
    the rows. ``together`` says that the rows of a slate are in one task already.
    """
    for threshold in thresholds:
        if not 0 < threshold < 1:
            raise ValueError(f"the similarity threshold must lie in (0, 1), got {threshold}")
    keys, width = list(keys), len(keys)
    levels = [float(t) for t in thresholds]
    rows = slates.select(*keys, "item_id", "rank")
    unique = (rows if together else spread(rows, *keys)).groupBy(*keys, "item_id").agg(F.min("rank").alias("rank"))
    held = held_items(items)
    if held is None:
        vectors = items.select("item_id", F.col("embedding").cast("array<double>").alias("embedding"))
        unique = spread(unique.join(vectors, "item_id").select(*keys, "item_id", "rank", "embedding"), *keys)
    known = None if held is None else slates.sparkSession.sparkContext.broadcast(held)
    names = ["param", *keys, "rank", "item_id"]

    def kept(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if known is None:
            vectors = part.column(width + 2)
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        else:
            ids, all_x = known.value
            at, there = places(ids, pc.fill_null(part.column(width), NO_ITEM).to_numpy(zero_copy_only=False))
            part, x = part.filter(pa.array(there)), all_x[at[there]]
        if not part.num_rows:
            return
        unit = unit_rows(x)
        first = key_starts(part, range(width))
        sizes = np.diff(np.r_[first, part.num_rows])
        begin = 0
        while begin < len(first):  # as many slates in one step as their padded vectors allow
            longest = np.maximum.accumulate(sizes[begin:])
            end = begin + max(1, int((longest * np.arange(1, len(longest) + 1) <= PADDED_ROWS).sum()))
            shown = [(level, walked_slates(unit, first[begin:end], sizes[begin:end], level, k)) for level in levels]
            for level, (slate, place, number) in shown:
                chosen = pa.array(first[begin:end][slate] + place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slate), level)), *[part.column(i).take(chosen) for i in range(width)],
                     pa.array(number.astype(np.int32)), part.column(width).take(chosen).cast(pa.int64())], names=names)
            begin = end

    types = {f.name: f.dataType.simpleString() for f in slates.schema.fields}
    key_schema = ", ".join(f"{c} {types[c]}" for c in keys)
    return unique.sortWithinPartitions(*keys, "rank", "item_id").mapInArrow(
        lambda batches: (out for part in whole_keys(batches, range(width)) for out in kept(part)),
        f"param double, {key_schema}, rank int, item_id long")


def walked_slates(unit: np.ndarray, first: np.ndarray, sizes: np.ndarray, level: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slate, place, number) of what the walks keep. Slate s is ``unit[first[s]:first[s] + sizes[s]]``; all take a step at once."""
    n, longest = len(first), int(sizes.max())
    step = np.arange(longest)
    inside = step < sizes[:, None]
    x = unit[np.where(inside, first[:, None] + step, first[:, None])]
    closest = np.full((n, longest), -np.inf)
    keep, count = np.zeros((n, longest), bool), np.zeros(n, np.int64)
    for i in range(longest):
        own = np.flatnonzero(inside[:, i] & (count < k) & ((count == 0) | (closest[:, i] < level)))
        if len(own):
            keep[own, i] = True
            count[own] += 1
            if i + 1 < longest:
                alike = np.matmul(x[own, i + 1:], x[own, i, :, None])[:, :, 0]
                closest[own, i + 1:] = np.maximum(closest[own, i + 1:], alike)
        if (count >= np.minimum(k, sizes)).all():
            break
    slate, place = np.nonzero(keep)
    return slate, place, np.cumsum(keep, axis=1)[slate, place]


def rerank_batch(slates: DataFrame, items: DataFrame, threshold: float, k: int,
                 cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slates, counts): diversity filter over many cases.

    Counts hold ``n_cases, n_empty, n_unchanged``; cases without a slate pass through.
    """
    slates = cut_lineage(slates.select("case_id", "rank", "item_id"))  # read twice
    out = diversity_filter(slates, items, [threshold], k).drop("param")
    before = slates.where(F.col("rank") <= k).groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("old"))
    after = out.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("new"))
    joined = cases.select("case_id").distinct().join(before, "case_id", "left").join(
        after, "case_id", "left")
    counts = joined.agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("new").isNull()).alias("n_empty"),
        F.count_if(F.transform("old", lambda x: x["item_id"]) ==
                   F.transform("new", lambda x: x["item_id"])).alias("n_unchanged"))
    return out, counts


def popularity_then_diversity(slates: DataFrame, popularity: DataFrame, cutoffs: DataFrame,
                              items: DataFrame, thresholds: Sequence[float], k: int) -> DataFrame:
    """``pop_param, div_param, case_id, rank, item_id`` over the whole grid."""
    first = popularity_filter(slates, popularity, cutoffs, k).withColumnRenamed(
        "param", "pop_param")
    # the windows of the first step left each slate in one task
    second = diversity_filter(first, items, thresholds, k, ["pop_param", "case_id"], together=True)
    return second.withColumnRenamed("param", "div_param").select(
        "pop_param", "div_param", "case_id", "rank", "item_id")


def model_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    """All unordered pairs of model names."""
    return list(combinations(sorted(set(models)), 2))


def best_parameters(reports: DataFrame, metric: str = "NDCG", top_k: int = 20) -> DataFrame:
    """``model, param, value``: the parameter with the best mean over folds."""
    rows = reports.where((F.col("metric") == metric) & (F.col("top_k") == top_k))
    means = rows.groupBy("model", "param").agg(F.avg("value").alias("value"))
    order = F.struct("value", (-F.col("param")).alias("p"))
    return means.groupBy("model").agg(F.max_by("param", order).alias("param"),
                                      F.max("value").alias("value"))


def split_names(reports: DataFrame) -> DataFrame:
    """``m1-m2-method-param`` model names as four columns."""
    parts = F.split("model", "-")
    return reports.withColumns({
        "model_1": parts[0], "model_2": parts[1],
        "method": F.element_at(parts, -2), "param": F.element_at(parts, -1)})


def format_results(reports: DataFrame, metrics: Sequence[str], top_ks: Sequence[int] = (10, 20)
                   ) -> DataFrame:
    """One row per combined model, metric columns in order, best NDCG@10 first."""
    from slatewright.operators.evaluation import report_table
    keys = ["model_1", "model_2", "method", "param"]
    wide = report_table(split_names(reports), top_ks, metrics, keys)
    return wide.orderBy(F.desc("`NDCG@10`"), *keys)
