"""Metrics of one's own as mergeable aggregates: start, update, merge, finalise.

A metric sees each case's slate, its truth and the places of the hits. Tasks fold the cases they
hold into one state for each model and k, so only states are shuffled; states of one model and k
are merged and finalised together, one for each task there was.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a metric may ask for besides the slates.
INPUTS = ("item_counts", "n_items")


@dataclass(frozen=True)
class Case:
    """One judged slate. ``counts`` are the items' counts in training, if the metric needs ``item_counts``."""

    case_id: int
    top_k: int
    slate: list[int]
    truth: list[int]
    hits: list[int]  #: 1-based places of relevant items
    counts: list[int] = field(default_factory=list)
    n_items: int | None = None


class Metric(ABC):
    """A measure of slates. States may be any object that pickles; ``merge`` must not depend on the order.

    By default the values of the cases are averaged: then only ``name`` and ``case`` are needed.
    """

    name: str = ""
    needs: tuple[str, ...] = ()

    @abstractmethod
    def case(self, case: Case) -> Any:
        """The value of one case."""

    def start(self) -> Any:
        return 0.0, 0

    def update(self, state: Any, value: Any) -> Any:
        return state[0] + value, state[1] + 1

    def merge(self, state: Any, other: Any) -> Any:
        return state[0] + other[0], state[1] + other[1]

    def finalise(self, state: Any) -> float | None:
        return state[0] / state[1] if state[1] else 0.0


def check(metric: Metric, given: dict[str, bool]) -> None:
    if not metric.name:
        raise ValueError(f"{type(metric).__name__} has no name")
    for need in metric.needs:
        if need not in INPUTS:
            raise ValueError(f"metric {metric.name} needs {need!r}, which is none of {INPUTS}")
        if not given[need]:
            raise ValueError(f"metric {metric.name} needs {need}")


def with_counts(found: DataFrame, keys: Sequence[str], item_counts: DataFrame) -> DataFrame:
    """Adds ``counts``, the counts of the slate's items in their order; items never counted have 0."""
    own = [*keys, "case_id", "top_k"]
    items = found.select(*own, F.posexplode("slate").alias("_at", "item_id"))
    looked_up = items.join(item_counts.select("item_id", "count"), "item_id", "left").groupBy(*own).agg(
        F.array_sort(F.collect_list(F.struct("_at", F.coalesce("count", F.lit(0)).alias("n")))).alias("_c"))
    return found.join(looked_up, own, "left").withColumn(
        "counts", F.coalesce(F.transform("_c", lambda x: x["n"].cast("long")), F.array().cast("array<bigint>"))).drop("_c")


def measured(found: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], item_counts: DataFrame | None = None,
             n_items: int | None = None) -> DataFrame:
    """``keys, top_k, metric, value`` from ``keys, case_id, top_k, slate, truth, hits``."""
    keys = list(keys)
    metrics = list(metrics)
    if any("item_counts" in m.needs for m in metrics):
        found = with_counts(found, keys, item_counts)
    else:
        found = found.withColumn("counts", F.array().cast("array<bigint>"))
    n_keys = len(keys)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                group, rest = tuple(row[:n_keys]), row[n_keys:]
                case = Case(int(rest[0]), int(rest[1]), *[[int(x) for x in column] for column in rest[2:]], n_items=n_items)
                for i, metric in enumerate(metrics):
                    at = (*group, case.top_k, i)
                    state = states[at] if at in states else metric.start()
                    states[at] = metric.update(state, metric.case(case))
        yield pd.DataFrame([(*at, pickle.dumps(state)) for at, state in states.items()], columns=[*keys, "top_k", "number", "state"])

    def merge(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        metric = metrics[int(group[-1])]
        state = metric.start()
        for raw in frame["state"]:
            state = metric.merge(state, pickle.loads(raw))
        value = metric.finalise(state)
        return pd.DataFrame([(*group[:-1], metric.name, None if value is None else float(value))], columns=[*keys, "top_k", "metric", "value"])

    types = dict(found.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "top_k"])
    partial = found.select(*keys, "case_id", "top_k", "slate", "truth", "hits", "counts").mapInPandas(fold, f"{schema}, number int, state binary")
    return partial.groupBy(*keys, "top_k", "number").applyInPandas(merge, f"{schema}, metric string, value double")
