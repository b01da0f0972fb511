"""Training and prediction tables of fixed-length item sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewright.functions import sequences as S
from slatewright.operators.cases import as_arrays
from slatewright.operators.ranking import top_n


def sequence_table(rows: DataFrame, length: int, key: str = "case_id") -> DataFrame:
    """``key, sequence``: last ``length`` known items, padded with -1 on the left.

    Unknown ids leave gaps in the places, so the last known items are taken by order; what
    lies before them is cut before rows are gathered.
    """
    known = rows.where(F.col("item_id") != S.PADDING).select(key, "pos", "item_id")
    recent = top_n(known, [key], [F.desc("pos")], length)
    arrays = as_arrays(recent, [key])
    return arrays.select(key, S.padded(F.col("items"), length).alias("sequence"))


def next_item_rows(rows: DataFrame, length: int, key: str = "case_id") -> DataFrame:
    """``key, input, target``: targets are the inputs shifted by one."""
    table = sequence_table(rows, length + 1, key)
    return table.select(key, S.next_item_input(F.col("sequence"), length).alias("input"),
                        S.next_item_target(F.col("sequence"), length).alias("target"))


def next_item_prediction_rows(rows: DataFrame, length: int, key: str = "case_id") -> DataFrame:
    table = sequence_table(rows, length + 1, key)
    return table.select(key, F.slice("sequence", 2, length).alias("input"))


def next_item_validation_rows(rows: DataFrame, length: int, key: str = "case_id") -> DataFrame:
    """``key, input, target``: the last item is held back, only its place counts."""
    table = sequence_table(rows, length + 1, key)
    return table.select(key, F.slice("sequence", 1, length).alias("input"),
                        S.only_last(F.col("sequence"), length).alias("target"))


def cloze_rows(rows: DataFrame, length: int, mask: Column, prob: float, seed: int,
               copies: int = 10, key: str = "case_id") -> DataFrame:
    """``key, copy, input, target``: copy 0 masks the last place, the others random ones."""
    table = sequence_table(rows, length, key).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    last, some = S.at_end(length), S.at_random(prob, seed, key, "copy")

    def chosen(i):
        return F.when(F.col("copy") == 0, last(i)).otherwise(some(i))

    sequence = F.col("sequence")
    return table.select(key, "copy", S.masked(sequence, chosen, mask).alias("input"),
                        S.masked_target(sequence, chosen).alias("target"))


def cloze_prediction_rows(rows: DataFrame, length: int, mask: Column, key: str = "case_id"
                          ) -> DataFrame:
    """``key, input``: shifted left, mask id in the last place."""
    table = sequence_table(rows, length, key)
    return table.select(key, S.shifted_with_mask(F.col("sequence"), length, mask).alias("input"))


def multi_hot(rows: DataFrame, space: int, ignore_outside: bool = False, key: str = "case_id"
              ) -> DataFrame:
    """``key, item_id, n``: sparse counts; ids outside 0..space-1 fail or are skipped."""
    inside = (F.col("item_id") >= 0) & (F.col("item_id") < space)
    if not ignore_outside:
        message = F.concat(F.lit("item id outside the space: "), F.col("item_id").cast("string"))
        rows = rows.withColumn("item_id", F.when(inside, F.col("item_id")).otherwise(
            F.raise_error(message).cast("long")))
    else:
        rows = rows.where(inside)
    return rows.groupBy(key, "item_id").agg(F.count(F.lit(1)).alias("n"))


def initial_vectors(mapping: DataFrame, reduced: DataFrame) -> DataFrame:
    """``idx, embedding``: reduced item vectors in the order of dense ids."""
    return mapping.join(reduced.select("item_id", "embedding"), "item_id").select(
        "idx", "embedding")
