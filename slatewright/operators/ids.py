"""Dense item numbering and translation back and forth.

Joins work on original ids everywhere; dense ids are for consumers that need 0..n-1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewright.operators.ranking import rank_overall, rerank

UNKNOWN = -1


def dense_ids(log: DataFrame, column: str, first_seen: Sequence[str]) -> DataFrame:
    """``column, idx``: 0-based ids by first appearance under ``first_seen``.

    Only one row per distinct value is ordered.
    """
    order = F.struct(*first_seen)
    firsts = log.groupBy(column).agg(F.min(order).alias("_first"))
    firsts = firsts.select(column, "_first.*") if column not in first_seen else \
        firsts.select(column, *[F.col(f"_first.{c}").alias(c) for c in first_seen if c != column])
    ranked = rank_overall(firsts, [F.col(c) for c in first_seen], name="_rank")
    return ranked.select(column, (F.col("_rank") - 1).alias("idx"))


def to_dense(df: DataFrame, mapping: DataFrame, column: str = "item_id") -> DataFrame:
    """Replace original ids by dense ones; ids without a mapping become -1."""
    return (df.join(mapping, column, "left").drop(column)
            .withColumn(column, F.coalesce("idx", F.lit(UNKNOWN)).cast("long")).drop("idx"))


def to_original(df: DataFrame, mapping: DataFrame, column: str = "item_id") -> DataFrame:
    """Replace dense ids by original ones."""
    back = mapping.select(F.col("idx").alias("_idx"), F.col(column).alias("_original"))
    return (df.join(back, df[column] == back["_idx"]).drop(column, "_idx")
            .withColumnRenamed("_original", column))


def arrays_to_dense(lists: DataFrame, mapping: DataFrame, key: str = "case_id",
                    items: str = "items", column: str = "item_id") -> DataFrame:
    """Translate id arrays; unknown ids become -1 and order is kept."""
    rows = lists.select(key, F.posexplode(items).alias("pos", column))
    return _gather(to_dense(rows, mapping, column), key, column, items)


def arrays_to_original(lists: DataFrame, mapping: DataFrame, key: str = "case_id",
                       items: str = "items", column: str = "item_id") -> DataFrame:
    rows = lists.select(key, F.posexplode(items).alias("pos", column))
    return _gather(to_original(rows, mapping, column), key, column, items)


def _gather(rows, key, column, items):
    packed = F.array_sort(F.collect_list(F.struct("pos", column)))
    return rows.groupBy(key).agg(F.transform(packed, lambda x: x[column]).alias(items))


def lookup_array(mapping: DataFrame, column: str = "item_id") -> DataFrame:
    """The mapping as a table sorted by dense id (position i holds the i-th original)."""
    return mapping.select("idx", column).orderBy("idx")


def map_known(slates: DataFrame, mapping: DataFrame, key: Sequence[str] = ("case_id",),
              column: str = "item_id") -> DataFrame:
    """Translate slates, dropping unknown ids and closing the rank gaps."""
    joined = slates.join(mapping, column).drop(column).withColumnRenamed("idx", column)
    return rerank(joined, list(key), [F.col("rank")])
