"""Cleaning, de-duplication and the k-core."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewright.session import cut_lineage


def complete_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows where every required field is present."""
    return df.na.drop(subset=list(required))


def reject_counts(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: ``n_rows, n_rejected`` and one ``missing_<field>`` per field."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required]
    any_missing = F.lit(False)
    for c in required:
        any_missing = any_missing | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(any_missing).alias("n_rejected"), *missing)


def tidy(df: DataFrame, renames: dict[str, str], types: dict[str, str],
         keys: Sequence[str]) -> DataFrame:
    """Rename, drop rows with null keys, cast."""
    out = df.withColumnsRenamed(renames).na.drop(subset=list(keys))
    return out.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def with_known_items(log: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions whose item has metadata."""
    return log.join(items.select("item_id").distinct(), "item_id", "left_semi")


def used_items(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items that occur in the log."""
    return items.join(log.select("item_id").distinct(), "item_id", "left_semi")


def _first_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, smallest in ``order``.

    ``min_by`` aggregates map-side, so a heavily repeated key moves one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    picked = df.groupBy(*key).agg(best)
    return picked.select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_interactions(log: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """The first interaction of each session with each item."""
    return _first_by(log, ["session_id", "item_id"], order)


def unique_items(items: DataFrame, order: Sequence[str], key: str = "item_id") -> DataFrame:
    """One row per item id, the first in ``order``."""
    return _first_by(items, [key], order)


def duplicate_items(items: DataFrame, key: str = "item_id") -> DataFrame:
    """``key, count`` for ids that occur more than once."""
    return items.groupBy(key).count().where("count > 1")


def k_core(log: DataFrame, min_rows: int = 5) -> DataFrame:
    """Largest sub-log where each session and each item has ``min_rows`` rows.

    Rows are counted once by session and once by item. A step marks the keys of one kind that have
    too few, and takes the rows they had off the other kind's counts, until none fails. A step writes
    one table, the other kind's counts; the log is filtered once at the end. The result does not
    depend on the order.
    """
    sides, columns = ("session_id", "item_id"), log.columns
    counts = {key: cut_lineage(log.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("gone"))) for key in sides}
    few, quiet = F.col("n") < min_rows, 0
    while quiet < 2:
        for key, other in (sides, sides[::-1]):
            failing = counts[key].where(few & ~F.col("gone")).select(key)
            if failing.isEmpty():
                quiet += 1
                continue
            quiet = 0
            gone = counts[other].where("gone").select(other)
            lost = (log.join(failing, key, "left_semi").join(gone, other, "left_anti")
                    .groupBy(other).agg(F.count(F.lit(1)).alias("_lost")))
            counts[key] = counts[key].withColumn("gone", few)
            counts[other] = cut_lineage(counts[other].join(lost, other, "left").select(
                other, (F.col("n") - F.coalesce("_lost", F.lit(0))).alias("n"), "gone"))
    for key in sides:
        log = log.join(counts[key].where(few).select(key), key, "left_anti")
    return log.select(*columns)


def fill_unnamed(items: DataFrame, dim: int, placeholder: str = "Unknown item") -> DataFrame:
    """Give items without a name the placeholder and a zero vector."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return items.select(
        "item_id", F.coalesce("name", F.lit(placeholder)).alias("name"),
        F.when(F.col("name").isNull(), zero).otherwise(F.col("embedding")).alias("embedding"))


def drop_unnamed(items: DataFrame, placeholder: str = "Unknown item") -> DataFrame:
    return items.where(F.col("name").isNotNull() & (F.col("name") != placeholder))


def vector_lengths(items: DataFrame, column: str = "embedding") -> DataFrame:
    """``dim, n``: how many vectors have which length; one row means all agree."""
    return items.groupBy(F.size(column).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
