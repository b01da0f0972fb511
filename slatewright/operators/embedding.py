"""Session vectors from item vectors, and recommendation by vector similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewright.functions.decay import check_decay, decay_weight, start_weight
from slatewright.functions.vectors import scale
from slatewright.operators.blocks import MEASURES, held_items, nearest, nearest_to_means
from slatewright.operators.ranking import spread

STRATEGIES = ("mean", "last", "concat")


def with_length(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """Adds ``n``, the number of rows of the key, unless it is there already."""
    if "n" in rows.columns:
        return rows
    lengths = rows.groupBy(key).agg(F.max("pos").alias("n"))
    return rows.join(lengths, key)


def weighted_rows(rows: DataFrame, decay: str | None = None, weight=None, key: str = "case_id", floor: float = 1e-5) -> DataFrame:
    """``key, item_id, _w``: rows with their weights, shuffled once, so that a key's rows lie in one task."""
    rows = spread(rows.where(F.col(key).isNotNull()), key)
    if "n" not in rows.columns:
        rows = rows.withColumn("n", F.max("pos").over(Window.partitionBy(key)))
    weight = weight or (lambda pos, n: decay_weight(decay, pos, n, floor))
    return rows.select(key, "item_id", weight(F.col("pos"), F.col("n")).alias("_w"))


def session_vectors(rows: DataFrame, items: DataFrame, strategy: str = "mean",
                    decay: str | None = None, key: str = "case_id", weight=None,
                    floor: float = 1e-5, max_items: int | None = None) -> DataFrame:
    """``key, vector`` from ``key, pos, item_id`` rows and ``item_id, embedding``.

    ``mean`` is the weighted average, summed map-side, so session length does not
    matter; ``last`` takes the latest item; ``concat`` joins the weighted vectors in
    order (``max_items`` keeps the latest so many).  ``weight`` overrides the decay with
    a function of position and length.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {STRATEGIES}")
    rows = with_length(rows, key)
    vectors = items.select("item_id", "embedding")
    if strategy == "last":
        return (rows.where(F.col("pos") == F.col("n")).join(vectors, "item_id")
                .select(key, F.col("embedding").alias("vector")))
    weight = weight or (lambda pos, n: decay_weight(decay, pos, n, floor))
    weighted = rows.withColumn("_w", weight(F.col("pos"), F.col("n")))
    if strategy == "mean":
        per_item = weighted.groupBy(key, "item_id").agg(F.sum("_w").alias("_w"))
        joined = per_item.join(vectors, "item_id").withColumn(
            "_v", array_to_vector("embedding"))
        mean = Summarizer.metrics("mean").summary(F.col("_v"), F.col("_w")).alias("_s")
        return joined.groupBy(key).agg(mean).select(
            key, vector_to_array("_s.mean").alias("vector"))
    if max_items is not None:
        weighted = weighted.where(F.col("pos") > F.col("n") - max_items)
    joined = weighted.join(vectors, "item_id")
    pieces = F.array_sort(F.collect_list(F.struct(
        "pos", scale(F.col("embedding"), F.col("_w")).alias("v"))))
    return joined.groupBy(key).agg(pieces.alias("_p")).select(
        key, F.flatten(F.transform("_p", lambda p: p["v"])).alias("vector"))


@dataclass(frozen=True)
class SimilarityOptions:
    """Options of the vector recommender."""

    measure: str = "cosine"
    strategy: str = "mean"
    decay: str | None = "harmonic"
    start_weights: str | None = None
    strict: bool = False
    push_seen: bool = True

    def __post_init__(self):
        if self.measure not in MEASURES:
            raise ValueError(f"unknown measure {self.measure!r}; choose one of {MEASURES}")
        if self.strategy not in ("mean", "last"):
            raise ValueError("scoring all items needs the mean or last strategy")
        check_decay(self.decay)


def recommend_similar(prompts: DataFrame, items: DataFrame, k: int,
                      options: SimilarityOptions = SimilarityOptions(),
                      model: str = "similar") -> DataFrame:
    """``model, case_id, rank, item_id, score``: items nearest to the session vector.

    Items of the prompt come last (score lowered by 10^9), or are left out if strict.
    """
    weight = None
    if options.start_weights is not None:
        weight = lambda pos, n: start_weight(options.start_weights, pos, n)
    held = held_items(items) if options.strategy == "mean" else None
    if held is not None:
        rows = weighted_rows(prompts, options.decay, weight)
        found = nearest_to_means(rows, held, k, options.measure, options.push_seen, options.strict)
        return found.select(F.lit(model).alias("model"), "case_id", "rank", "item_id", "score")
    vectors = session_vectors(prompts, items, options.strategy, options.decay, weight=weight)
    seen = None
    if options.push_seen or options.strict:
        seen = "seen"
        known = prompts.groupBy("case_id").agg(F.collect_set("item_id").alias("seen"))
        vectors = vectors.join(known, "case_id")
    found = nearest(vectors, items, k, options.measure, seen=seen, strict=options.strict)
    return found.select(F.lit(model).alias("model"), "case_id", "rank", "item_id", "score")


def drop_from_first_zero(recs: DataFrame) -> DataFrame:
    """Cut every slate at its first zero score."""
    zero = recs.where("score = 0").groupBy("model", "case_id").agg(F.min("rank").alias("_stop"))
    joined = recs.join(zero, ["model", "case_id"], "left")
    return joined.where(F.col("_stop").isNull() | (F.col("rank") < F.col("_stop"))).drop("_stop")


def averaged_word_vectors(texts: DataFrame, vocabulary: DataFrame, key: str = "item_id",
                          text: str = "name") -> DataFrame:
    """``key, embedding``: mean of the vectors of known words.

    ``vocabulary`` holds ``word, vector``; words outside it are skipped and texts
    without any known word do not appear.
    """
    words = texts.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("word"))
    counted = words.where("word <> ''").groupBy(key, "word").agg(
        F.count(F.lit(1)).cast("double").alias("_w"))
    joined = counted.join(vocabulary, "word").withColumn("_v", array_to_vector("vector"))
    mean = Summarizer.metrics("mean").summary(F.col("_v"), F.col("_w")).alias("_s")
    return joined.groupBy(key).agg(mean).select(key, vector_to_array("_s.mean").alias("embedding"))


def cached_embeddings(texts: DataFrame, cache: DataFrame, engine: str,
                      embed: Callable[[Sequence[str]], Sequence[Sequence[float]]],
                      batch_size: int = 250) -> tuple[DataFrame, DataFrame]:
    """(all, missing): vectors of distinct texts, and those computed just now.

    ``cache`` holds ``text, engine, embedding``.  Only texts it lacks reach ``embed``,
    ``batch_size`` at a time. Both results are lazy and each use of the second embeds anew:
    :func:`embeddings_through_cache` stores it and embeds every text once.
    """
    wanted = texts.select("text").distinct()
    known = cache.where(F.col("engine") == engine).select("text", "embedding")
    missing = wanted.join(known, "text", "left_anti")

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame["text"].iloc[start:start + batch_size].tolist()
                vectors = [[float(v) for v in row] for row in embed(part)]
                yield pd.DataFrame({"text": part, "embedding": vectors})

    fresh = missing.mapInPandas(compute, "text string, embedding array<double>")
    fresh = fresh.select("text", F.lit(engine).alias("engine"), "embedding")
    reused = wanted.join(known, "text")
    return reused.unionByName(fresh.select("text", "embedding")), fresh


def embeddings_through_cache(texts: DataFrame, path: str, engine: str,
                             embed: Callable[[Sequence[str]], Sequence[Sequence[float]]],
                             batch_size: int = 250) -> DataFrame:
    """``text, embedding`` of distinct texts through the cache table at ``path``.

    What the table lacks is embedded, one call per text, and appended to it; the result
    is read from the table. A missing table is begun.
    """
    spark = texts.sparkSession
    schema = "text string, engine string, embedding array<double>"
    try:
        cache = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        cache = spark.createDataFrame([], schema)
    _, fresh = cached_embeddings(texts, cache, engine, embed, batch_size)
    fresh.write.mode("append").parquet(path)
    known = spark.read.schema(schema).parquet(path).where(F.col("engine") == engine)
    return texts.select("text").distinct().join(known.select("text", "embedding"), "text")
