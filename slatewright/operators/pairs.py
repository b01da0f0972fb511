"""Likeness of pairs of a prompt and a session by item vectors that every task holds.

A session reaches the prompt's task as the places of its items in the table of vectors, two or four bytes an item, and
is compared there; vectors of sessions never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.operators.blocks import NO_ITEM, places
from slatewright.operators.ranking import key_starts, spread, whole_keys


def _binary(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """One binary value a list, from the lists' sizes and their flat values."""
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of each list and the end of the last one, flat values) of what :func:`_binary` made."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(dtype) if data is not None else np.empty(0, dtype)
    return (offsets - offsets[0]) // np.dtype(dtype).itemsize, values


def item_places(rows: DataFrame, key: str, held: Broadcast, dtype, in_order: bool) -> DataFrame:
    """``key, _at, _w, _norm`` from ``key, _back, item_id, _w``: the held items of each key and their weights, as binary values.

    ``in_order`` keeps them by place from the end, with gaps; otherwise ``_norm`` is the length of their weighted mean."""
    missing = np.iinfo(dtype).max

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = lists.flatten()
            back = entries.field("_back").to_numpy(zero_copy_only=False)
            at, there = places(ids, pc.fill_null(entries.field("item_id"), NO_ITEM).to_numpy(zero_copy_only=False))
            weights = entries.field("_w").to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(sizes)), sizes)
            if in_order:
                ends = np.zeros(len(sizes), np.int64)
                np.maximum.at(ends, own, back + 1)
                slot = (np.cumsum(ends) - ends)[own] + back
                placed, held_weights = np.full(int(ends.sum()), missing, dtype), np.zeros(int(ends.sum()))
                placed[slot], held_weights[slot] = np.where(there, at, missing).astype(dtype), weights
                sizes, norms, kept = ends, np.zeros(len(sizes)), np.arange(len(sizes))
            else:
                own, at, held_weights = own[there], at[there], weights[there]
                sizes = np.bincount(own, minlength=len(sizes))
                kept = np.flatnonzero(sizes)
                sizes = sizes[kept]
                first = np.cumsum(sizes) - sizes
                norms = np.empty(0)
                if len(kept):
                    sums = np.add.reduceat(held_weights[:, None] * y[at], first, axis=0)
                    norms = np.linalg.norm(sums / np.add.reduceat(held_weights, first)[:, None], axis=1)
                placed = at.astype(dtype)
            plain = (held_weights == 1.0).all()
            told = pa.nulls(len(kept), pa.binary()) if plain else _binary(sizes, held_weights)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), _binary(sizes, placed), told, pa.array(norms)],
                                             names=[key, "_at", "_w", "_norm"])

    entry = F.struct(F.col("_back").cast("long").alias("_back"), F.col("item_id").cast("long").alias("item_id"), F.col("_w").cast("double").alias("_w"))
    gathered = rows.groupBy(F.col(key).cast("long").alias(key)).agg(F.collect_list(entry).alias("_l"))
    return gathered.mapInArrow(encode, f"{key} long, _at binary, _w binary, _norm double")


def held_similarity(pairs: DataFrame, ours: DataFrame, theirs: DataFrame, held: tuple[np.ndarray, np.ndarray], name: str,
                    in_order: bool) -> DataFrame:
    """``case_id, session_id, last_pos, n, sim`` of pairs by the weighted means of item vectors, or, ``in_order``, by vectors
    laid end to end and compared from the last one backwards over the shorter side.

    ``ours`` (case_id) and ``theirs`` (session_id) hold ``_back, item_id, _w``, places from the end. Pairs without a
    vector on one side are left out."""
    dtype = np.uint16 if len(held[0]) < 1 << 16 else np.uint32
    missing = np.iinfo(dtype).max
    known = pairs.sparkSession.sparkContext.broadcast(held)
    kept = [F.col(c).cast("long").alias(c) for c in ("case_id", "session_id", "last_pos", "n")]
    # narrow rows are shuffled by session, and again with the session's places by case
    met = pairs.select(*kept).join(item_places(theirs, "session_id", known, dtype, in_order).hint("merge"), "session_id")
    prompts = item_places(ours, "case_id", known, dtype, in_order)
    rows = met.unionByName(prompts, allowMissingColumns=True).select("case_id", "session_id", "last_pos", "n", "_at", "_w", "_norm")

    def by_means(y, x_at, x_w, at, weights, first, norms):
        x = (x_w[:, None] * y[x_at]).sum(axis=0) / x_w.sum()
        if len(at) < len(y):
            values = y[at] @ x
        else:
            values = (y @ x)[at]
        value = np.add.reduceat(values * weights, first) / np.add.reduceat(weights, first)
        if name == "cosine":
            lengths = np.linalg.norm(x) * norms
            value = np.divide(value, lengths, out=np.zeros(len(value)), where=lengths > 0)
        return np.arange(len(first)), value

    def by_places(y, x_at, x_w, at, weights, first, norms):
        sizes = np.diff(np.r_[first, len(at)])
        own, back = np.repeat(np.arange(len(first)), sizes), np.arange(len(at)) - np.repeat(first, sizes)
        both = np.flatnonzero((back < len(x_at)) & (at != missing))
        both = both[x_at[back[both]] != missing]
        own, back, at = own[both], back[both], at[both]
        x, z = x_w[back][:, None] * y[x_at[back]], weights[both][:, None] * y[at]
        xy, xx, yy = (np.bincount(own, np.einsum("ij,ij->i", a, b), len(first)) for a, b in ((x, z), (x, x), (z, z)))
        found = np.flatnonzero(np.bincount(own, minlength=len(first)))
        return found, xy[found] if name == "dot" else xy[found] / np.sqrt(xx[found] * yy[found])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = known.value[1]
        for batch in whole_keys(batches, [0]):
            starts = key_starts(batch, [0])
            is_prompt = pc.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
            offsets, flat = _flat(batch.column(4), dtype)
            weighted, own_weights = _flat(batch.column(5), np.float64)
            norms = batch.column(6).to_numpy(zero_copy_only=False)
            # a list without weights has ones
            listed = np.diff(weighted) > 0
            weights = np.ones(len(flat))
            weights[np.repeat(listed, np.diff(offsets))] = own_weights
            chosen, values = [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                if not is_prompt[a] or b == a + 1:
                    continue
                begin, middle, end = offsets[a], offsets[a + 1], offsets[b]
                found, value = (by_places if in_order else by_means)(
                    y, flat[begin:middle], weights[begin:middle], flat[middle:end], weights[middle:end], offsets[a + 1:b] - middle, norms[a + 1:b])
                chosen.append(found + a + 1)
                values.append(value)
            if chosen:
                told = pa.array(np.concatenate(chosen))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(told) for i in range(4)], pa.array(np.concatenate(values))],
                                                 names=["case_id", "session_id", "last_pos", "n", "sim"])

    placed = spread(rows, "case_id").sortWithinPartitions(F.col("case_id"), F.asc_nulls_first("session_id"))
    found = placed.mapInArrow(walk, "case_id long, session_id long, last_pos long, n long, sim double")
    return found.withColumn("sim", F.round("sim", 9))
