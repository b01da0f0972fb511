"""Exact row numbers and top-n lists that do not depend on one big task.

A plain ``row_number() over (partition by key)`` sorts a whole key in one task.
The functions here give the same numbers but split what may be large:

* ``rank_overall``  numbers a whole table without a one-task sort,
* ``rank_within``   numbers rows per key; keys above ``hot_rows`` are sorted by ranges,
* ``top_n``         keeps the best n per key, cutting map-side before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewright.session import cut_lineage

HOT_ROWS = 1_000_000
# Spark prunes row_number() <= n before the shuffle only up to this n
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1_000


# Tasks per ordinary shuffle partition in front of a step that multiplies rows.
FAN_OUT = 2
# Rows that such a step makes in one task, where their number is known beforehand.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, *columns: str, rows: float = 0) -> DataFrame:
    """Hash ``df`` finely before a step that multiplies its rows or runs Python per group.

    Adaptive execution sizes partitions by the bytes it sees, so a narrow table that is
    about to fan out would end up in too few tasks.  The partition number differs from
    the default one on purpose: an equal one would be folded into the shuffle before it
    and coalesced again. ``rows`` is how many rows the step makes; more than ``TASK_ROWS``
    a task would be sorted and hashed on disk, so there are as many tasks as that takes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(FAN_OUT * n, math.ceil(rows / TASK_ROWS)), *columns)


def rank_overall(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """1-based position of every row under ``order`` over the whole table.

    A range shuffle sorts, whatever the distribution of the keys: busy days and sparse ids
    only move its bounds. The sorted rows are written, and each partition's own numbers
    are shifted by the sizes of those before it; the only one-task step adds up one
    number per partition. Ties in all of ``order`` may take each other's place.
    """
    marked = cut_lineage(df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftright("_mark", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (marked.withColumn("_part", part).join(shifts, "_part")
            .withColumn(name, (F.col("_shift") + own).cast("long")).drop("_part", "_mark", "_shift"))


def running_total(df: DataFrame, order: Sequence[Column], weight: str, name: str = "before") -> DataFrame:
    """The sum of ``weight`` over all rows before each row under ``order``, over the whole table.

    As :func:`rank_overall`: a range shuffle sorts, each partition adds up its own rows, and the only one-task step
    adds up one number per partition. ``order`` must not leave ties.
    """
    marked = cut_lineage(df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id())
                         .withColumn("_part", F.spark_partition_id()))
    sizes = marked.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_sum").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    own = F.coalesce(F.sum(weight).over(
        Window.partitionBy("_part").orderBy("_mark").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_own", own).join(shifts, "_part").withColumn(name, F.col("_shift") + F.col("_own")).drop(
        "_mark", "_part", "_own", "_shift")


def rank_within(df: DataFrame, key: Sequence[str], order: Sequence[Column], name: str = "pos",
                hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """1-based position of every row inside its key under ``order``.

    Keys with at most ``hot_rows`` rows are numbered by one window partition. The rows of
    larger keys are ranked together by key and order as in :func:`rank_overall`, and each
    key's first place is taken off. ``sizes`` (``key, _rows``) may give an upper bound of
    the rows per key that is cheaper to compute than counting ``df``.
    """
    key = list(key)
    if sizes is None:
        sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = cut_lineage(sizes.where(F.col("_rows") > hot_rows).select(*key))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")
    if hot.isEmpty():
        return df.withColumn(name, number)
    placed = rank_overall(df.join(hot, key, "left_semi"), [*[F.col(c) for c in key], *order], "_place")
    first = placed.groupBy(*key).agg(F.min("_place").alias("_first"))
    large = placed.join(first, key).withColumn(name, F.col("_place") - F.col("_first") + 1)
    usual = df.join(hot, key, "left_anti").withColumn(name, number)
    return usual.unionByName(large.drop("_place", "_first"))


def top_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int,
          name: str = "rank") -> DataFrame:
    """The first ``n`` rows per key, with their 1-based rank.

    Up to ``GROUP_LIMIT`` Spark itself cuts each map task's output to n rows per key. For
    larger n each task sorts its rows and keeps n a key before the shuffle, so a key that
    holds a third of the table reaches its final task as at most n rows from each task.
    """
    key = list(key)
    final = Window.partitionBy(*key).orderBy(*order)
    if n > GROUP_LIMIT:
        df = _first_in_tasks(df, key, order, n)
    ranked = df.withColumn(name, F.row_number().over(final))
    return ranked.where(F.col(name) <= n)


def _first_in_tasks(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key of each task, which sorts its own rows; nothing is shuffled."""
    places = [df.columns.index(c) for c in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i) for i in places]
            own = tuple(c[0].as_py() for c in columns)
            starts = key_starts(batch, places)[1:]
            offset = taken if own == last else 0
            at = np.arange(batch.num_rows)
            begin = np.zeros(batch.num_rows, np.int64)
            begin[starts] = starts
            place = at - np.maximum.accumulate(begin)
            first_end = int(starts[0]) if len(starts) else batch.num_rows
            place[:first_end] += offset
            last, taken = tuple(c[-1].as_py() for c in columns), int(place[-1]) + 1
            kept = np.flatnonzero(place < n)
            if len(kept):
                yield batch.take(pa.array(kept))

    return df.sortWithinPartitions(*[F.col(c) for c in key], *order).mapInArrow(run, df.schema)


def key_starts(batch: pa.RecordBatch, places: Sequence[int]) -> np.ndarray:
    """Rows of a sorted batch where the key in the columns ``places`` is another one than before, 0 among them; nulls are a key of their own."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for column in (batch.column(i) for i in places):
        here, before = column.slice(1), column.slice(0, max(0, batch.num_rows - 1))
        differ = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        odd = pc.is_null(here).to_numpy(zero_copy_only=False) != pc.is_null(before).to_numpy(zero_copy_only=False)
        new[1:] |= differ | odd
    return np.flatnonzero(new)


def whole_keys(batches: Iterator[pa.RecordBatch], places: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The same sorted rows in batches that no key is cut by. Keys must be small, as a whole one is held."""
    held: list[pa.RecordBatch] = []  # rows of the last key, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            joint = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if len(key_starts(joint, places)) > 1:
                yield pa.concat_batches(held)
                held = []
        end = int(key_starts(batch, places)[-1])
        if end:
            yield pa.concat_batches([*held, batch.slice(0, end)])
            held = []
        held.append(batch.slice(end))
    if held:
        yield pa.concat_batches(held)


def rerank(df: DataFrame, key: Sequence[str], order: Sequence[Column],
           name: str = "rank") -> DataFrame:
    """Dense 1..n ranks again after rows were dropped from bounded slates."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_new", F.row_number().over(window)).drop(name).withColumnRenamed(
        "_new", name)
