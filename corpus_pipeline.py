"""A training corpus from documents: toxicity, near duplicates, contamination, mixture, shards.

Every stage works on all that its predecessor kept. ``run`` applies STAGES to the
documents of a folder; each stage's result is written to the shared folder and reread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewright.llm import decontamination, jaccard, mixing, sharding, toxicity
from slatewright.llm.shared import documents, position, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the threshold go; the model learns from the labelled documents of the input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("toxicity") < toxicity.THRESHOLD).drop("toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect one row stays: five-word shingles, 0.8 or more.

    Rows are what is linked, whatever their doc_id: the row with the smallest doc_id stays, any row with one before
    those without. Rows that share a doc_id but no likeness all stay, and so do texts without words.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR doc_id IS NULL")
    if odd.isEmpty():  # as usual; then doc_ids stand for rows, and the texts are shuffled once
        return _first_of_groups(docs.select(*COLUMNS), "doc_id").select(*COLUMNS)
    marked = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
    numbered = position(marked, [F.asc_nulls_last("doc_id"), "_hash", "_tie"], "_row", "numbered-rows")
    return _first_of_groups(numbered, "_row").select(*COLUMNS)


def _first_of_groups(docs: DataFrame, node: str) -> DataFrame:
    """The rows of ``docs`` with the smallest ``node`` of their group; ``node`` is unique."""
    groups = jaccard.linked_components(docs.select(F.col(node).alias("doc_id"), "text"), width=5, percent=80)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(node))
    return docs.join(gone, node, "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean_documents(docs.select(*COLUMNS), benchmark, size=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their size to the power 0.7: Poisson copies, globally shuffled."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all rows in SHARDS shards that hold the same mixture: doc_id, source, size, text_crc32, shard, slot."""
    return sharding.assign_shards(docs, shards=SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Scores of a fitted model have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
