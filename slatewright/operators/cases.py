"""Prompts and ground truths: what a model sees and what it should say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.operators.ranking import top_n


def session_lengths(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return log.groupBy(*keys, "session_id").agg(F.max("pos").alias("n"))


def _cut(log: DataFrame, n_withheld: int, keys: Sequence[str]):
    if n_withheld < 1:
        raise ValueError("n_withheld must be a positive integer")
    lengths = session_lengths(log, keys).where(F.col("n") > n_withheld)
    return log.join(lengths, [*keys, "session_id"])


def prompts(log: DataFrame, n_withheld: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """``case_id, pos, item_id``: every session without its last ``n_withheld`` items."""
    return (_cut(log, n_withheld, keys).where(F.col("pos") <= F.col("n") - n_withheld)
            .select(*keys, F.col("session_id").alias("case_id"), "pos", "item_id"))


def ground_truths(log: DataFrame, n_withheld: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """``case_id, pos, item_id``: the last ``n_withheld`` items, numbered from 1."""
    return (_cut(log, n_withheld, keys).where(F.col("pos") > F.col("n") - n_withheld)
            .select(*keys, F.col("session_id").alias("case_id"),
                    (F.col("pos") - F.col("n") + n_withheld).alias("pos"), "item_id"))


def _evolving_id(step, max_id: int):
    return step * F.lit(2 * max_id) + F.col("session_id") + 1


def _max_session(log: DataFrame) -> int:
    return log.agg(F.max("session_id").alias("m")).first()["m"] or 0


def evolving_cases(log: DataFrame, n_withheld: int = 1) -> DataFrame:
    """``case_id, session_id, upto``: one row per prefix, linear in the log.

    The prompt of a case is rows 1..upto of its session, its truth the rows after.
    """
    return evolving_rows(log, n_withheld).select("case_id", "session_id", F.col("pos").alias("upto"))


def evolving_rows(log: DataFrame, n_withheld: int = 1) -> DataFrame:
    """``case_id, session_id, pos, item_id``: the prompts' rows, each with the case of the prefix that ends there."""
    rows = _cut(log, n_withheld, ()).where(F.col("pos") <= F.col("n") - n_withheld)
    return rows.select(_evolving_id(F.col("pos") - 1, _max_session(log)).alias("case_id"), "session_id", "pos", "item_id")


def evolving_prompts(log: DataFrame, n_withheld: int = 1,
                     last_items: int | None = None) -> DataFrame:
    """Every prefix of a prompt is a case of its own.

    Row ``pos`` of a session belongs to all prefixes of at least that length, so the
    written-out form grows with the square of the session length; rows are repeated
    where they are, never gathered per session.  ``last_items`` keeps the last so many
    items of each prefix (positions then start at 1), which makes the output linear.
    """
    max_id = _max_session(log)
    rows = _cut(log, n_withheld, ()).where(F.col("pos") <= F.col("n") - n_withheld)
    longest = F.col("n") - n_withheld - 1
    if last_items is not None:
        longest = F.least(longest, F.col("pos") + last_items - 2)
    rows = rows.withColumn("_step", F.explode(F.sequence(F.col("pos") - 1, longest)))
    pos = F.col("pos")
    if last_items is not None:
        pos = pos - F.greatest(F.lit(0), F.col("_step") + 1 - last_items)
    return rows.select(_evolving_id(F.col("_step"), max_id).alias("case_id"),
                       pos.alias("pos"), "item_id")


def evolving_truths(log: DataFrame, n_withheld: int = 1) -> DataFrame:
    """The ``n_withheld`` items that follow each prefix of :func:`evolving_prompts`."""
    max_id = _max_session(log)
    rows = _cut(log, n_withheld, ()).where(F.col("pos") >= 2)
    lowest = F.greatest(F.lit(0), F.col("pos") - 1 - n_withheld)
    highest = F.least(F.col("pos") - 2, F.col("n") - n_withheld - 1)
    steps = F.explode(F.sequence(lowest, highest))
    return rows.where(lowest <= highest).withColumn("_step", steps).select(
        _evolving_id(F.col("_step"), max_id).alias("case_id"),
        (F.col("pos") - 1 - F.col("_step")).alias("pos"), "item_id")


def named_only(log: DataFrame, unnamed_items: DataFrame) -> DataFrame:
    """Sessions that touch no unnamed item, whole."""
    touched = log.join(unnamed_items.select("item_id"), "item_id", "left_semi")
    return log.join(touched.select("session_id").distinct(), "session_id", "left_anti")


def first_distinct(rows: DataFrame, n: int, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """``keys, pos, item_id``: the first ``n`` different items of each case, at their first place; what is beyond is cut
    before anything is gathered."""
    keys = list(keys)
    firsts = rows.groupBy(*keys, "item_id").agg(F.min("pos").alias("pos"))
    return top_n(firsts, keys, [F.col("pos")], n).select(*keys, "pos", "item_id")


def as_arrays(rows: DataFrame, keys: Sequence[str] = ("case_id",),
              max_items: int | None = None) -> DataFrame:
    """``case_id, items``: ordered arrays, for sequence tables and text.

    ``max_items`` keeps the last so many items of each case before they are gathered.
    """
    keys = list(keys)
    if max_items is not None:
        lengths = rows.groupBy(*keys).agg(F.max("pos").alias("_n"))
        rows = rows.join(lengths, keys).where(F.col("pos") > F.col("_n") - max_items)
    packed = F.array_sort(F.collect_list(F.struct("pos", "item_id")))
    return rows.groupBy(*keys).agg(
        F.transform(packed, lambda x: x["item_id"]).alias("items"))
