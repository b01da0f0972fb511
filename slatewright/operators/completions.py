"""From model completions back to catalogue items.

Completions are a table ``case_id, candidate, text``.  Where the choice of one item
depends on the items chosen before it, a case is walked in order by a small function, many
cases in a batch; lists of near items that fit a task are sent to it once, longer ones are joined.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewright.functions.text import parse_delimited, parse_numbered, parse_single
from slatewright.operators.blocks import nearest
from slatewright.operators.ranking import key_starts, spread, top_n, whole_keys
from slatewright.session import cut_lineage

#: Rows of lists of near items that are sent to every task; longer ones are joined.
NEAR_ROWS = 1_000_000


def parsed(completions: DataFrame, task: str, k: int = 20) -> DataFrame:
    """``case_id, candidate, rank, name``: the names in a completion, in order."""
    text = F.col("text")
    names = {"single": F.array(parse_single(text)), "list": parse_delimited(text, k),
             "classify": parse_numbered(text, k), "rank": parse_numbered(text, k)}[task]
    rows = completions.select("case_id", "candidate", F.posexplode(names).alias("_at", "name"))
    return rows.select("case_id", "candidate", (F.col("_at") + 1).alias("rank"), "name")


def answer_counts(rows: DataFrame) -> DataFrame:
    """``case_id, name, n, first``: repeats of an answer over the candidates of a case.

    ``first`` orders the answers by their first (candidate, rank); both fit into 32 bits.
    """
    return rows.groupBy("case_id", "name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.shiftleft(F.col("candidate").cast("long"), 32) + F.col("rank")).alias("first"))


def name_index(names: DataFrame) -> DataFrame:
    """``name, item_id``: the largest id where a name is shared."""
    return names.groupBy("name").agg(F.max("item_id").alias("item_id"))


def matched(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``item_id`` of an exactly equal name, NULL without one."""
    return rows.join(name_index(names), "name", "left")


def unmatched_names(rows: DataFrame) -> DataFrame:
    """Distinct names without a catalogue item."""
    return rows.where(F.col("item_id").isNull()).select("name").distinct()


def _nearest_per_name(name_vectors: DataFrame, items: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``name, place, near_id``: the ``most`` items (``wanted``: name, most) nearest to each name by dot product.

    Names are asked for in levels: those that want up to ``k`` items, up to twice as many, and so on. A name's list is
    at most twice as long as it wants, and a long one lengthens no other.
    """
    wanted = cut_lineage(wanted)
    longest, level, out = wanted.agg(F.max("most")).first()[0] or 0, k, None
    lower = 0
    while out is None or lower < longest:
        asked = wanted.where((F.col("most") > lower) & (F.col("most") <= level))
        keyed = name_vectors.join(asked, "name").select("name", "most", F.xxhash64("name").alias("case_id"), "vector")
        near = nearest(keyed.select("case_id", "vector"), items, level, "dot")
        part = near.join(keyed.select("case_id", "name", "most"), "case_id").where(F.col("rank") <= F.col("most")).select(
            "name", F.col("rank").alias("place"), F.col("item_id").alias("near_id"))
        out = part if out is None else out.unionByName(part)
        lower, level = level, 2 * level
    return out


class _Near:
    """The lists of ``near`` by name, read from sorted arrays as they are asked for."""

    def __init__(self, names: np.ndarray, places: np.ndarray, near_ids: np.ndarray) -> None:
        self.names, self.first = np.unique(names, return_index=True)
        self.end = np.r_[self.first[1:], len(names)]
        self.places, self.near_ids, self.read = places, near_ids, {}

    def __call__(self, name: int | None) -> tuple[list[int], list[int]]:
        """(places, items) of a name, by place."""
        if name not in self.read:
            at = None if name is None else int(np.searchsorted(self.names, name))
            if at is None or at == len(self.names) or self.names[at] != name:
                return [], []
            own = slice(self.first[at], self.end[at])
            self.read[name] = self.places[own].tolist(), self.near_ids[own].tolist()
        return self.read[name]


def _held_near(near: DataFrame, wanted: DataFrame) -> Broadcast | None:
    """The arrays of :class:`_Near`, names by their hash, on every task, where all lists together have up to NEAR_ROWS rows; otherwise None."""
    if (wanted.agg(F.sum("most")).first()[0] or 0) > NEAR_ROWS:
        return None
    rows = near.select(F.xxhash64("name").alias("name"), "place", "near_id").toArrow()
    columns = [rows.column(c).to_numpy() for c in ("name", "place", "near_id")]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    return near.sparkSession.sparkContext.broadcast(tuple(c[order] for c in columns))


def _by_case(rows: DataFrame, order: list, make_walk: Callable[[_Near], Callable], held: Broadcast) -> DataFrame:
    """``case_id, rank, item_id``: what a walk, made once a task, gives for the columns after ``case_id`` of each case, as lists.

    Rows pass sorted, many cases in a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = make_walk(_Near(*held.value))
        for batch in whole_keys(batches, [0]):
            starts = key_starts(batch, [0])
            columns, out, sizes = [c.to_pylist() for c in batch.columns[1:]], [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                found = walk(*[c[a:b] for c in columns])
                out += found
                sizes.append(len(found))
            cases = batch.column(0).take(pa.array(np.repeat(starts, sizes)))
            yield pa.RecordBatch.from_arrays([cases, pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64())],
                                             names=["case_id", "rank", "item_id"])

    placed = spread(rows.withColumn("case_id", F.col("case_id").cast("long")), "case_id")
    return placed.sortWithinPartitions("case_id", *order).mapInArrow(run, "case_id long, rank int, item_id long")


def _filling(lists: _Near) -> Callable:
    """The walk of :func:`fill_unmatched` over ``rank, item_id, name`` (without a name where the item is known)."""
    def walk(ranks: list, own: list, names: list) -> list[tuple]:
        used = {x for x in own if x is not None}
        out, i = [], 0
        while i < len(ranks):
            end = i + 1
            while end < len(ranks) and ranks[end] == ranks[i]:
                end += 1
            if end == i + 1 and own[i] is not None:
                out.append((ranks[i], own[i]))
            else:  # answers of one rank share their candidates, the closest first; what is known already comes after
                offered = _offered([lists(name) for name, mine in zip(names[i:end], own[i:end]) if mine is None])
                chosen = next((x for x in offered if x not in used), None)
                if chosen is not None:
                    used.add(chosen)
                else:
                    chosen = next((x for x in own[i:end] if x is not None), None)
                out.append((ranks[i], chosen))
            i = end
        return out
    return walk


def _replacing(lists: _Near, k: int) -> Callable:
    """The walk of :func:`replace_repeats` over ``first, n, item_id, name``; rows without ``first`` are the prompt's items."""
    def walk(firsts: list, counts: list, own: list, names: list) -> list[tuple]:
        barred = {x for x in own if x is not None}
        begin = next((i for i, x in enumerate(firsts) if x is not None), len(firsts))
        wanted, offers, direct = {}, {}, []
        for first, n, mine, name in zip(firsts[begin:], counts[begin:], own[begin:], names[begin:]):
            if first not in wanted:
                wanted[first] = n
                if mine is not None:
                    direct.append(mine)
                    wanted[first] -= 1
            if name is not None:
                places, near_ids = lists(name)
                end = bisect.bisect_right(places, n + k)
                offers.setdefault(first, []).append((places[:end], near_ids[:end]))
        taken, extra = set(), []
        for first, own_offers in offers.items():
            for x in _offered(own_offers):
                if wanted[first] < 1:
                    break
                if x not in barred and x not in taken:
                    wanted[first] -= 1
                    taken.add(x)
                    extra.append(x)
        return list(enumerate(direct + extra, 1))
    return walk


def _offered(lists: list[tuple[list[int], list[int]]]) -> list[int]:
    """Items of one or several lists (places, items), the closest first."""
    return lists[0][1] if len(lists) == 1 else [x for _, x in sorted((p, x) for own in lists for p, x in zip(*own))]


def fill_unmatched(rows: DataFrame, name_vectors: DataFrame, items: DataFrame, k: int
                   ) -> DataFrame:
    """``case_id, rank, item_id``: unmatched names become the nearest unused item.

    A slate of n names rules out at most n - 1 items, so n candidates suffice for a name in
    slates of up to n names: ``k``, or more where a slate is longer. A name without a
    vector keeps its rank with a NULL item.
    """
    sizes = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    wanted = rows.where(F.col("item_id").isNull()).join(sizes, "case_id").groupBy("name").agg(
        F.greatest(F.lit(k), F.max("_n")).alias("most"))
    wanted = cut_lineage(wanted)
    near = _nearest_per_name(name_vectors, items, wanted, k)
    held = _held_near(near, wanted)
    if held is not None:
        unknown = F.col("item_id").isNull() & F.col("name").isNotNull()
        told = rows.select("case_id", "rank", F.col("item_id").cast("long").alias("item_id"), F.when(unknown, F.xxhash64("name")).alias("name"))
        return _by_case(told, ["rank"], _filling, held)
    with_near = rows.join(near, "name", "left")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "place"])
        own = frame["item_id"].to_numpy(dtype=float, na_value=np.nan)
        used = {int(v) for v in own[~np.isnan(own)]}
        chosen: dict[int, int] = {}
        for rank, mine, near_id in zip(frame["rank"], own, frame["near_id"]):
            if rank in chosen:
                continue
            if not np.isnan(mine):
                chosen[rank] = int(mine)
            elif not pd.isna(near_id) and int(near_id) not in used:
                used.add(int(near_id))
                chosen[rank] = int(near_id)
        ranks = list(dict.fromkeys(frame["rank"]))
        return pd.DataFrame({"case_id": frame["case_id"].iloc[0], "rank": ranks,
                             "item_id": pd.array([chosen.get(r) for r in ranks], "Int64")})

    columns = with_near.select("case_id", "rank", "item_id", "place", "near_id")
    return spread(columns, "case_id").groupBy("case_id").applyInPandas(
        walk, "case_id long, rank int, item_id long")


def replace_repeats(counts: DataFrame, names: DataFrame, name_vectors: DataFrame,
                    items: DataFrame, prompts: DataFrame, k: int) -> DataFrame:
    """``case_id, rank, item_id`` for repeated or unknown single answers.

    An answer given c times keeps its item (if it has one) and gets ``c - exists`` of its
    nearest ``c + k`` items that are neither in the prompt, nor an answer, nor taken.
    Replacements follow at the end.
    """
    labelled = matched(counts, names)
    needs = labelled.where((F.col("n") > 1) | F.col("item_id").isNull())
    wanted = cut_lineage(needs.groupBy("name").agg((F.max("n") + k).alias("most")))
    near = _nearest_per_name(name_vectors, items, wanted, k + 1)
    held = _held_near(near, wanted)
    if held is not None:
        is_asked = ((F.col("n") > 1) | F.col("item_id").isNull()) & F.col("name").isNotNull()
        told = labelled.select("case_id", "first", "n", F.col("item_id").cast("long").alias("item_id"), F.when(is_asked, F.xxhash64("name")).alias("name"))
        # a prompt's items come before the answers, as rows without a place
        barred = prompts.select("case_id", F.col("item_id").cast("long").alias("item_id")).distinct()
        return _by_case(told.unionByName(barred, allowMissingColumns=True), ["first", F.asc_nulls_last("name")],
                        lambda lists: _replacing(lists, k), held)
    offered = needs.select("case_id", "name", "n").join(near, "name").where(
        F.col("place") <= F.col("n") + k).drop("n")
    shown = prompts.select("case_id", F.col("item_id").alias("near_id")).distinct()
    answers = labelled.where(F.col("item_id").isNotNull()).select(
        "case_id", F.col("item_id").alias("near_id")).distinct()
    offered = offered.join(shown, ["case_id", "near_id"], "left_anti").join(
        answers, ["case_id", "near_id"], "left_anti")
    rows = labelled.join(offered, ["case_id", "name"], "left")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["first", "place"])
        own = frame["item_id"].to_numpy(dtype=float, na_value=np.nan)
        near = frame["near_id"].to_numpy(dtype=float, na_value=np.nan)
        taken, direct, extra, wanted = set(), [], [], {}
        for first, n, mine, near_id in zip(frame["first"], frame["n"], own, near):
            if first not in wanted:
                wanted[first] = int(n)
                if not np.isnan(mine):
                    direct.append(int(mine))
                    wanted[first] -= 1
            if wanted[first] > 0 and not np.isnan(near_id) and int(near_id) not in taken:
                wanted[first] -= 1
                taken.add(int(near_id))
                extra.append(int(near_id))
        chosen = direct + extra
        return pd.DataFrame({"case_id": frame["case_id"].iloc[0],
                             "rank": range(1, len(chosen) + 1), "item_id": chosen})

    columns = rows.select("case_id", "first", "n", "item_id", "place", "near_id")
    return spread(columns, "case_id").groupBy("case_id").applyInPandas(
        walk, "case_id long, rank int, item_id long")


def likeness(x: Column, y: Column) -> Column:
    """Share of characters that need no edit, in [0, 1]."""
    longest = F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.lit(1.0) - F.levenshtein(x, y) / longest


def match_allowed(rows: DataFrame, allowed: DataFrame,
                  score: Callable[[Column, Column], Column] = likeness) -> DataFrame:
    """``case_id, rank, choice, is_exact, is_duplicate``: names mapped to a case's list.

    ``allowed`` holds ``case_id, place, choice``.  An exact match wins, otherwise the
    most similar entry; a name whose entry is taken gets its closest free one.  Both
    lists are short, so comparing them inside a case is cheap.
    """
    pairs = rows.select("case_id", "rank", "name").join(allowed, "case_id")
    scored = pairs.withColumn("alike", F.round(score(F.col("name"), F.col("choice")), 9))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["rank", "alike", "place"], ascending=[True, False, True])
        options: dict[int, list[str]] = {}
        asked: dict[int, str] = {}
        for rank, name, choice in zip(ordered["rank"], ordered["name"], ordered["choice"]):
            options.setdefault(rank, []).append(choice)
            asked[rank] = name
        used, out = set(), []
        for rank, choices in options.items():
            exact = asked[rank] in choices
            best = asked[rank] if exact else choices[0]
            repeated = best in used
            if repeated:
                best = next((c for c in choices if c not in used), best)
            used.add(best)
            out.append((ordered["case_id"].iloc[0], rank, best, exact, repeated))
        return pd.DataFrame(out, columns=["case_id", "rank", "choice", "is_exact",
                                          "is_duplicate"])

    return spread(scored, "case_id").groupBy("case_id").applyInPandas(
        walk, "case_id long, rank int, choice string, is_exact boolean, is_duplicate boolean")


def match_report(choices: DataFrame) -> DataFrame:
    """One row: exact, inexact and duplicate matches."""
    return choices.agg(F.count_if("is_exact").alias("n_exact"),
                       F.count_if(~F.col("is_exact")).alias("n_inexact"),
                       F.count_if("is_duplicate").alias("n_duplicate"))


def first_names(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows of every case."""
    return top_n(rows, ["case_id"], [F.col("candidate"), F.col("rank")], k, name="place")
