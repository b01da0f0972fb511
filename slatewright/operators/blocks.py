"""Products of two vector tables, block by block.

``nearest`` keeps each query in one task, which walks over the blocks of items with a running
list of the best k: items of a checked size are broadcast, larger tables pass each task as a
stream of blocks, once for every block of queries; queries are never copied. All-pairs counts
meet in tiles of two blocks. Rows of single vector pairs never exist outside a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.session import cut_lineage

BLOCK_ROWS = 4096
#: Queries that a task ranks at once, and rows that their lists may hold together.
QUERY_ROWS = 1024
HELD_ROWS = 1_000_000
#: Rows that a task ranks and returns at once.
TABLE_ROWS = 125_000
#: Bytes of queries that meet one copy of the item blocks, where these are too large to be broadcast.
STREAM_BYTES = 64 * 1024 * 1024
#: Bins of a task's histogram of pairs, and their number in one coarse bin.
BINS, COARSE = 1 << 20, 1 << 10
BROADCAST_BYTES = 64 * 1024 * 1024

# Score added to items of the prompt, so that they come last.
SEEN_PENALTY = -1e9

# Fixed value: stands for a missing id, which no item has.
NO_ITEM = -(1 << 63)

MEASURES = ("cosine", "dot", "euclidean", "negative_euclidean")


def _pack(df: DataFrame, ident: str, vector: str, n_blocks: int, block: str,
          extra: Sequence[str] = ()) -> DataFrame:
    """``block, entries``: vectors grouped by hash of their id into ``n_blocks``."""
    label = F.pmod(F.xxhash64(ident), F.lit(n_blocks))
    entry = F.struct(F.col(ident).cast("long").alias("id"),
                     F.col(vector).cast("array<double>").alias("v"), *extra)
    return df.groupBy(label.alias(block)).agg(F.collect_list(entry).alias(f"{block}_rows"))


def _blocks_for(n_rows: int, at_least: int = 1) -> int:
    return max(at_least, math.ceil(n_rows / BLOCK_ROWS), 1)


def _meet(left: DataFrame, right: DataFrame, n_left: int, n_right: int, right_bytes: int,
          symmetric: bool = False) -> DataFrame:
    """Rows ``lb, lb_rows, rb, rb_rows`` for all (or the ordered) block pairs."""
    parallelism = left.sparkSession.sparkContext.defaultParallelism
    first = F.col("lb") if symmetric else F.lit(0).cast("long")
    tiles = left.withColumn("rb", F.explode(F.sequence(first, F.lit(n_right - 1).cast("long"))))
    if right_bytes <= BROADCAST_BYTES:
        tasks = max(1, min(n_left * n_right, 4 * parallelism))
        return tiles.repartition(tasks, "lb", "rb").join(F.broadcast(right), "rb")
    salts = max(1, math.ceil(4 * parallelism / n_right))
    spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = tiles.withColumn("salt", F.pmod("lb", F.lit(salts)).cast("int"))
    return keyed.join(spread, ["rb", "salt"]).drop("salt")


def _matrix(entries: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    rows = entries.values
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    vectors = rows.field("v")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1), rows


def _scores(x: np.ndarray, y: np.ndarray, measure: str) -> np.ndarray:
    inner = x @ y.T
    if measure == "dot":
        return inner
    if measure == "cosine":
        lengths = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        return np.divide(inner, lengths, out=np.zeros_like(inner), where=lengths > 0)
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * inner
    distance = np.sqrt(np.maximum(squared, 0.0))
    return -distance if measure == "negative_euclidean" else 1.0 / (1.0 + distance)


def _at_once(queries: int, k: int) -> int:
    """How many of ``queries`` with lists of ``k`` items a task ranks at once."""
    return max(1, min(queries, min(HELD_ROWS, TABLE_ROWS) // max(1, k)))


def _first_of_rows(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, id, value) the k of each row with the largest values, in their order, ties by id."""
    order = np.lexsort((ids, -values, rows))
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    order = order[place < k]
    return rows[place < k], ids[order], values[order]


class _Best:
    """The k best items of each query row, over any number of item blocks.

    ``seen`` holds (row, item id) pairs that are pushed to the end of the order. Only scores near the k-th are rounded
    and sorted, all rows of a block at once."""

    def __init__(self, x: np.ndarray, k: int, measure: str, seen: tuple[np.ndarray, np.ndarray] | None, strict: bool) -> None:
        self.x = unit_rows(x) if measure == "cosine" else x
        self.k, self.measure, self.seen, self.strict = k, measure, seen, strict
        self.rows, self.ids, self.values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def take(self, ids: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(ids)
        ids, y = ids[order], y[order]
        scores = self.x @ unit_rows(y).T if self.measure == "cosine" else _scores(self.x, y, self.measure)
        self.push_down(scores, ids)
        if self.k < len(ids):
            edge = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            # what may be as large as the k-th once it is rounded
            edge = edge - np.where(edge > SEEN_PENALTY / 2, 2e-9 + 4e-15 * np.abs(edge), 0.0)
            rows, columns = np.nonzero(scores >= edge[:, None])
            values = scores[rows, columns]
            values = np.where(values < SEEN_PENALTY / 2, values, np.round(values, 9))
            rows, found, values = _first_of_rows(rows, ids[columns], values, self.k)
        else:  # whole rows, ids in order already
            scores = np.where(scores < SEEN_PENALTY / 2, scores, np.round(scores, 9))
            columns = np.argsort(-scores, axis=1, kind="stable")
            rows, found = np.repeat(np.arange(len(scores)), len(ids)), ids[columns].ravel()
            values = np.take_along_axis(scores, columns, axis=1).ravel()
        if self.strict:
            shown = values > SEEN_PENALTY / 2
            rows, found, values = rows[shown], found[shown], values[shown]
        if len(self.rows):
            rows, found, values = _first_of_rows(np.concatenate([self.rows, rows]), np.concatenate([self.ids, found]),
                                                 np.concatenate([self.values, values]), self.k)
        self.rows, self.ids, self.values = rows, found, values

    def push_down(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.seen is not None:
            rows, known = self.seen
            at = np.searchsorted(ids, known)
            inside = at < len(ids)
            inside[inside] = ids[at[inside]] == known[inside]
            rows, at = rows[inside], at[inside]
            scores[rows, at] = np.round(scores[rows, at], 9) + SEEN_PENALTY

    def table(self, queries: np.ndarray, names: list[str]) -> pa.RecordBatch:
        sizes = np.bincount(self.rows, minlength=len(queries))
        place = np.arange(len(self.rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        columns = [queries[self.rows], place, self.ids, self.values]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)],
                                          names=names)


def unit_rows(x: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all entries of a list column."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def nearest(queries: DataFrame, items: DataFrame, k: int, measure: str = "cosine",
            query: str = "case_id", vector: str = "vector", item: str = "item_id",
            embedding: str = "embedding", seen: str | None = None, strict: bool = False) -> DataFrame:
    """``query, rank, item, score``: the k best items for each query vector.

    ``seen`` names an array column of item ids that are pushed to the end of the order
    (or left out with ``strict``).  ``k=-1`` returns the full order.  Scores are rounded
    to nine decimals before ranking and ties go to the smaller id. A query is ranked where
    it lies: its vector and list are moved once at most, however many items there are.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; choose one of {MEASURES}")
    n_items = items.count()
    k = n_items if k == -1 else min(k, n_items)
    dim = (items.select(F.size(embedding)).first() or [0])[0]
    names, schema = [query, "rank", item, "score"], f"{query} long, rank int, {item} long, score double"
    columns = [F.col(query).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *([F.col(seen).alias("seen")] if seen else [])]
    item_columns = items.select(F.col(item).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    # a task holds the k best of so many queries at once
    most = _at_once(QUERY_ROWS, k)
    # and keeps those of a group, 16 bytes an item, while the blocks of items pass; the fewer groups, the fewer copies
    at_once = max(1, HELD_ROWS // k if k > QUERY_ROWS else STREAM_BYTES // (16 * max(1, k)))

    def parts(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                yield part.column(0).to_numpy(), _Best(x, k, measure, _listed(part.column(2)) if seen else None, strict)

    return _ranked(queries.select(*columns), parts, at_once, item_columns, n_items, dim, names, schema)


def held_items(items: DataFrame, item: str = "item_id", embedding: str = "embedding") -> tuple[np.ndarray, np.ndarray] | None:
    """Ids in their order and their vectors, where they are few enough to be sent to every task (BROADCAST_BYTES) and each
    id has one vector; otherwise None."""
    dim = items.select(F.size(embedding)).first()
    if dim is None or dim[0] is None or dim[0] < 1 or items.count() * (dim[0] * 8 + 24) > BROADCAST_BYTES:
        return None
    held = items.select(F.col(item).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).toArrow().combine_chunks()
    vectors = held.column("v").combine_chunks()
    flat = vectors.flatten()
    sizes = pc.list_value_length(vectors)
    if held.column("id").null_count or vectors.null_count or flat.null_count or not pc.all(pc.equal(sizes, dim[0])).as_py():
        return None
    ids = held.column("id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    if (ids[1:] == ids[:-1]).any():
        return None
    return ids, flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]


def places(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``ids``, and whether they are there."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return at, ids[at] == wanted


def _walked(ids: np.ndarray, y: np.ndarray, queries: np.ndarray, best: _Best, names: list[str]) -> pa.RecordBatch:
    for at in range(0, len(ids), BLOCK_ROWS):
        best.take(ids[at:at + BLOCK_ROWS], y[at:at + BLOCK_ROWS])
    return best.table(queries, names)


def nearest_to_means(rows: DataFrame, held: tuple[np.ndarray, np.ndarray], k: int, measure: str = "cosine", push_seen: bool = True,
                     strict: bool = False, key: str = "case_id", item: str = "item_id", weight: str = "_w") -> DataFrame:
    """``key, rank, item, score``: the k best of the ``held`` items for each key's weighted mean of item vectors.

    As :func:`nearest` with the key's ``session_vectors`` and its items as ``seen``, but only narrow rows are moved:
    ``rows`` (key, item, weight) must lie together by key. They pass as a sorted stream; a task adds vectors up as it
    reads them, so it holds one batch of rows, and a key of any length is one vector and its different items.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; choose one of {MEASURES}")
    k = len(held[0]) if k == -1 else min(k, len(held[0]))
    most = _at_once(QUERY_ROWS, k)
    known = rows.sparkSession.sparkContext.broadcast(held)
    names, schema = [key, "rank", item, "score"], f"{key} long, rank int, {item} long, score double"

    def walk(batches: Iterable[pa.RecordBatch]):
        ids, y = known.value

        def ranked(queries, sums, seen):
            kept = np.flatnonzero(sums[:, 0] > 0)  # keys without a known item have no vector
            place = np.full(len(queries), -1)
            place[kept] = np.arange(len(kept))
            x, queries, own = sums[kept, 1:] / sums[kept, :1], queries[kept], place[seen[0]]
            for at in range(0, len(queries), most):
                pairs = None
                if push_seen or strict:
                    inside = (own >= at) & (own < at + most)
                    pairs = own[inside] - at, seen[1][inside]
                yield _walked(ids, y, queries[at:at + most], _Best(x[at:at + most], k, measure, pairs, strict), names)

        last, carried, met = None, None, []  # the key that may go on in the next batch, its sums and items
        for batch in batches:
            if not batch.num_rows:
                continue
            queries, at, there, weights = batch.column(0).to_numpy(), *places(ids, _numbers(batch.column(1))), batch.column(2).to_numpy()
            weights = np.where(there, weights, 0.0)
            first = np.flatnonzero(np.r_[True, queries[1:] != queries[:-1]])
            sums = np.add.reduceat(np.concatenate([weights[:, None], weights[:, None] * y[at]], axis=1), first, axis=0)
            own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(queries)]))[there]
            seen = ids[at[there]]
            queries = queries[first]
            if last is not None and queries[0] == last:
                sums[0] += carried
                own, seen = np.r_[np.zeros(len(met), np.int64), own], np.r_[met, seen]
            elif last is not None:
                queries, sums = np.r_[last, queries], np.concatenate([carried[None], sums])
                own, seen = np.r_[np.zeros(len(met), np.int64), own + 1], np.r_[met, seen]
            end = len(queries) - 1
            last, carried, met = queries[end], sums[end].copy(), np.unique(seen[own == end])
            if end:
                yield from ranked(queries[:end], sums[:end], (own[own < end], seen[own < end]))
        if last is not None:
            yield from ranked(np.array([last]), carried[None], (np.zeros(len(met), np.int64), met))

    columns = rows.select(F.col(key).cast("long"), F.col(item).cast("long"), F.col(weight).cast("double"))
    return columns.sortWithinPartitions(key).mapInArrow(walk, schema)


def _numbers(column: pa.Array) -> np.ndarray:
    """Ids as numbers; one that is missing is no item's."""
    return pc.fill_null(column, NO_ITEM).to_numpy(zero_copy_only=False)


def nearest_of_sessions(rows: DataFrame, held: tuple[np.ndarray, np.ndarray], k: int, measure: str = "cosine", strict: bool = False,
                        push_seen: bool = True, item: str = "item_id") -> DataFrame:
    """``case_id, rank, item_id, score``: the k best of the ``held`` items for each prefix of the sessions.

    ``rows`` (session_id, pos, case_id, item_id, _w) holds a row a prefix, whose vector is the weighted mean over the
    session's rows up to this one; what those rows hold is seen. A session's rows are in one task and pass in order, so
    vectors are running sums there and never move. The longest session must fit a task.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; choose one of {MEASURES}")
    k = len(held[0]) if k == -1 else min(k, len(held[0]))
    most = _at_once(QUERY_ROWS, k)
    known = rows.sparkSession.sparkContext.broadcast(held)
    names, schema = ["case_id", "rank", item, "score"], f"case_id long, rank int, {item} long, score double"

    def walk(batches: Iterable[pa.RecordBatch]):
        ids, y = known.value

        def ranked(part: pa.RecordBatch):
            session, cases, weights = part.column(0).to_numpy(), part.column(2).to_numpy(), part.column(4).to_numpy()
            at, there = places(ids, _numbers(part.column(3)))
            weights = np.where(there, weights, 0.0)
            first = np.flatnonzero(np.r_[True, session[1:] != session[:-1]])
            begin = np.repeat(first, np.diff(np.r_[first, len(session)]))
            sums = np.concatenate([weights[:, None], weights[:, None] * y[at]], axis=1)
            for a, b in zip(first, np.r_[first[1:], len(session)]):
                np.cumsum(sums[a:b], axis=0, out=sums[a:b])
            queries = np.flatnonzero(sums[:, 0] > 0)
            for start in range(0, len(queries), most):
                own = queries[start:start + most]
                pairs = None
                if push_seen or strict:
                    sizes = own - begin[own] + 1
                    of = np.repeat(np.arange(len(own)), sizes)
                    met = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes - begin[own], sizes)
                    pairs = of[there[met]], ids[at[met[there[met]]]]
                yield _walked(ids, y, cases[own], _Best(sums[own, 1:] / sums[own, :1], k, measure, pairs, strict), names)

        held_back = None  # the rows of the last session, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held_back is None else pa.concat_batches([held_back, batch])
            session = whole.column(0).to_numpy()
            end = int(np.searchsorted(session, session[-1]))
            if end:
                yield from ranked(whole.slice(0, end))
            held_back = whole.slice(end)
        if held_back is not None:
            yield from ranked(held_back)

    columns = rows.select(*[F.col(c).cast("long") for c in ("session_id", "pos", "case_id", item)], F.col("_w").cast("double"))
    return columns.sortWithinPartitions("session_id", "pos").mapInArrow(walk, schema)


class _BestOfPrefixes(_Best):
    """The k best items of prefixes of one session; an item counts as seen from the place it was first met at."""

    def __init__(self, x: np.ndarray, upto: np.ndarray, known: np.ndarray, first: np.ndarray, k: int, measure: str, strict: bool) -> None:
        super().__init__(x, k, measure, None, strict)
        self.upto, self.known, self.first = upto, known, first

    def push_down(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.searchsorted(ids, self.known)
        inside = at < len(ids)
        inside[inside] = ids[at[inside]] == self.known[inside]
        own = scores[:, at[inside]]
        scores[:, at[inside]] = np.where(self.first[inside][None, :] <= self.upto[:, None], np.round(own, 9) + SEEN_PENALTY, own)


def nearest_of_prefixes(rows: DataFrame, items: DataFrame, k: int, measure: str, pack: int, strict: bool = False,
                        item: str = "item_id", embedding: str = "embedding") -> DataFrame:
    """``case_id, rank, item_id, score``: the k best items for each prefix of packs of prefixes.

    ``rows`` holds ``session_id, chunk, upto, key, first, v``. A pack (session_id, chunk) has a row for each of its prefixes, at
    most ``pack`` of them, with its case as ``key`` and its vector, and a row with ``upto`` 0 for each of the session's items
    (``key``) with the place it was first met at. Items that a prefix has met come last (or not at all if ``strict``). Packs are
    not gathered: their rows pass as a sorted stream, so a task holds one pack and one batch of narrow rows.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; choose one of {MEASURES}")
    n_items = items.count()
    k = n_items if k == -1 else min(k, n_items)
    dim = (items.select(F.size(embedding)).first() or [0])[0]
    item_columns = items.select(F.col(item).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    most = _at_once(pack, k)

    def parts(batches: Iterable[pa.RecordBatch]):
        known, own, now = [], [], None

        def ranked():
            if not own:
                return
            cases, upto, x = (np.concatenate(c) for c in zip(*own))
            seen, first = (np.concatenate(c) for c in zip(*known)) if known else (np.empty(0, np.int64), np.empty(0, np.int64))
            for at in range(0, len(cases), most):
                end = at + most
                yield cases[at:end], _BestOfPrefixes(x[at:end], upto[at:end], seen, first, k, measure, strict)

        for batch in batches:
            if not batch.num_rows:
                continue
            session, chunk, upto, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            cut = np.flatnonzero((session[1:] != session[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if now != (session[a], chunk[a]):
                    yield from ranked()
                    known, own, now = [], [], (session[a], chunk[a])
                middle = a + int(np.searchsorted(upto[a:b], 0, side="right"))
                if middle > a:
                    known.append((key[a:middle].copy(), batch.column(5).slice(a, middle - a).to_numpy(zero_copy_only=False).copy()))
                if b > middle:
                    x = batch.column(6).slice(middle, b - middle).flatten().to_numpy(zero_copy_only=False)
                    own.append((key[middle:b].copy(), upto[middle:b].copy(), x.reshape(b - middle, -1).copy()))
        yield from ranked()

    order = ["id", "session_id", "chunk", "upto"]
    queries = rows.select(F.xxhash64("session_id", "chunk").alias("id"), *[F.col(c).cast("long") for c in ("session_id", "chunk", "upto", "key", "first")], "v")
    schema = f"case_id long, rank int, {item} long, score double"
    return _ranked(queries, parts, max(1, HELD_ROWS // max(1, k)), item_columns, n_items, dim, ["case_id", "rank", item, "score"], schema, order)


def _ranked(queries: DataFrame, parts, at_once: int, items: DataFrame, n_items: int, dim: int, names: list[str], schema: str,
            order: Sequence[str] = ()) -> DataFrame:
    """``queries``, spread by ``id``, each walked past all items; ``parts`` makes lists of the best from batches of them,
    sorted by ``order``, the leading columns.

    At most ``at_once`` queries meet a stream of item blocks together where the items are too large to be broadcast. All
    blocks are copied to each such group, so a group has as many queries as STREAM_BYTES hold."""
    context = queries.sparkSession.sparkContext
    if n_items * (dim * 8 + 24) <= BROADCAST_BYTES:
        held = items.toArrow().combine_chunks()
        flat = held.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if n_items else np.empty(0)
        known = context.broadcast((held.column("id").to_numpy(), flat.reshape(n_items, -1) if n_items else np.empty((0, 0))))

        def walk(batches):
            ids, y = known.value
            for query_ids, best in parts(batches):
                for at in range(0, len(ids), BLOCK_ROWS):
                    best.take(ids[at:at + BLOCK_ROWS], y[at:at + BLOCK_ROWS])
                yield best.table(query_ids, names)

        placed = queries.repartition(4 * context.defaultParallelism, "id")
        return (placed.sortWithinPartitions(*order) if order else placed).mapInArrow(walk, schema)

    columns = queries.columns
    seen = [F.size("seen") * 8] if "seen" in columns else []
    n_queries, length = queries.select(sum((F.greatest(x, F.lit(0)) for x in seen), F.lit(dim * 8 + 24)).alias("_b")).agg(
        F.count(F.lit(1)), F.sum("_b")).first()
    n_left = max(context.defaultParallelism, math.ceil(n_queries / at_once), math.ceil((length or 0) / STREAM_BYTES))
    n_right = _blocks_for(n_items)
    empty = F.array().cast("array<struct<id:bigint,v:array<double>>>")
    gathered = F.collect_list(F.struct(*columns))
    gathered = F.array_sort(gathered) if order else gathered
    left = (queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_left)).alias("lb")).agg(gathered.alias("queries"))
            .select("lb", F.lit(-1).cast("long").alias("rb"), "queries", empty.alias("items")))
    right = (items.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_right)).alias("rb"))
             .agg(F.collect_list(F.struct("id", "v")).alias("items")))
    blocks = right.withColumn("lb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))))
    streams = left.unionByName(blocks.select("lb", "rb", F.lit(None).cast(left.schema["queries"].dataType).alias("queries"), "items"))
    # a block of queries, and after it the items, block by block
    streams = streams.repartition(n_left, "lb").sortWithinPartitions("lb", "rb")

    def stream(batches):
        block, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() < 0:
                    for ids, best in held:
                        yield best.table(ids, names)
                    block, rows = batch.column(0)[i].as_py(), batch.column(2)[i].values
                    held = list(parts([pa.RecordBatch.from_arrays([rows.field(c) for c in columns], names=columns)]))
                elif batch.column(0)[i].as_py() == block:
                    ids, y, _ = _matrix(batch.column(3)[i])
                    for _, best in held:
                        best.take(ids, y)
        for ids, best in held:
            yield best.table(ids, names)

    return streams.mapInArrow(stream, schema)


def pair_counts(items: DataFrame, edges: Sequence[tuple[float, float]], bins: int = BINS,
                measure: str = "cosine", item: str = "item_id",
                embedding: str = "embedding") -> DataFrame:
    """``part, bin, n``: unordered item pairs per bin of each half-open value range.

    The bins of ``edges[part]`` split that range evenly; values outside every range are
    not reported. A task keeps one histogram over all its tiles and emits it once.
    """
    n_items = items.count()
    dim = items.select(F.size(embedding)).first()[0]
    n = _blocks_for(n_items)
    left = _pack(items, item, embedding, n, "lb")
    right = left.select(F.col("lb").alias("rb"), F.col("lb_rows").alias("rb_rows"))
    tiles = _meet(left, right, n, n, n_items * (dim * 8 + 24), symmetric=True)
    ranges = [(float(lo), float(hi)) for lo, hi in edges]

    def count_tiles(batches):
        totals = np.zeros((len(ranges), bins), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("lb")[i].as_py() == batch.column("rb")[i].as_py()
                _, x, _ = _matrix(batch.column("lb_rows")[i])
                _, y, _ = _matrix(batch.column("rb_rows")[i])
                for at in range(0, len(x), 512):  # some rows at once, so that no whole tile of numbers is held twice
                    values = np.clip(_scores(x[at:at + 512], y, measure), -1.0, 1.0)
                    values = values[np.triu_indices(len(values), at + 1, len(y))] if same else values.ravel()
                    for p, (lo, hi) in enumerate(ranges):
                        inside = values[(values >= lo) & (values < hi)]
                        slot = np.minimum(np.floor((inside - lo) / ((hi - lo) / bins)).astype(np.int64), bins - 1)
                        if len(slot) > bins // 8:
                            totals[p] += np.bincount(slot, minlength=bins)
                        else:
                            np.add.at(totals[p], slot, 1)
        for p, own in enumerate(totals):
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int64)), pa.array(used.astype(np.int64)), pa.array(own[used])],
                                             names=["part", "bin", "n"])

    counted = tiles.select("lb", "rb", "lb_rows", "rb_rows").mapInArrow(
        count_tiles, "part long, bin long, n long")
    return counted.groupBy("part", "bin").agg(F.sum("n").alias("n"))


def similarity_quantiles(items: DataFrame, quantiles: Sequence[float], item: str = "item_id",
                         embedding: str = "embedding", bins: int = BINS,
                         tolerance: float = 2e-12) -> list[float]:
    """Interpolated quantiles of the cosine over all unordered item pairs.

    The order statistics next to each quantile are located by counting: a pass counts
    pairs per bin, the bins that hold a wanted rank are split again, until they are no wider
    than ``tolerance``, whose middle is taken. With BINS bins that is two products. The bins
    stay in Spark; the driver sees sums of COARSE bins and the bins of the wanted ones.
    An ordered pair list has the same quantiles up to the position
    of the interpolation, see :func:`ordered_pair_quantiles`.
    """
    n = items.count()
    pairs = n * (n - 1) // 2
    ranks = []
    for q in quantiles:
        place = q * (pairs - 1)
        ranks.append((math.floor(place), math.ceil(place), place - math.floor(place)))
    wanted = sorted({r for low, high, _ in ranks for r in (low, high)})
    values = _order_statistics(items, wanted, item, embedding, bins, tolerance)
    return [values[low] + (values[high] - values[low]) * part for low, high, part in ranks]


def ordered_pair_quantiles(items: DataFrame, quantiles: Sequence[float], item: str = "item_id",
                           embedding: str = "embedding", bins: int = BINS,
                           tolerance: float = 2e-12) -> list[float]:
    """Quantiles over both directions of each pair (the off-diagonal matrix entries)."""
    n = items.count()
    entries = n * (n - 1)
    ranks = []
    for q in quantiles:
        place = q * (entries - 1)
        ranks.append((math.floor(place) // 2, math.ceil(place) // 2, place - math.floor(place)))
    wanted = sorted({r for low, high, _ in ranks for r in (low, high)})
    values = _order_statistics(items, wanted, item, embedding, bins, tolerance)
    return [values[low] + (values[high] - values[low]) * part for low, high, part in ranks]


def _order_statistics(items, wanted, item, embedding, bins, tolerance):
    top = 1.0 + 2.0 ** -20  # so that 1, which may be met often, lies inside the last bin on every pass
    place = {rank: (-1.0, top, rank) for rank in wanted}
    while max(hi - lo for lo, hi, _ in place.values()) > tolerance:
        ranges = sorted({(lo, hi) for lo, hi, _ in place.values()})
        counts = cut_lineage(pair_counts(items, ranges, bins, "cosine", item, embedding))
        group = F.floor(F.col("bin") / COARSE)
        coarse = np.zeros((len(ranges), -(-bins // COARSE)), np.int64)
        for row in counts.groupBy("part", group.alias("bin")).agg(F.sum("n").alias("n")).collect():
            coarse[row["part"], row["bin"]] = row["n"]
        sums = coarse.cumsum(axis=1)
        # a value next to the edge of a bin may fall to its other side on the next pass; the rank then stays at that edge
        place = {rank: (lo, hi, max(0, min(inner, int(sums[ranges.index((lo, hi))][-1]) - 1))) for rank, (lo, hi, inner) in place.items()}
        found = {rank: (part := ranges.index((lo, hi)), int(np.searchsorted(sums[part], inner, side="right")))
                 for rank, (lo, hi, inner) in place.items()}
        read = " OR ".join(f"(part = {part} AND bin >= {g * COARSE} AND bin < {(g + 1) * COARSE})" for part, g in sorted(set(found.values())))
        fine = {}
        for row in counts.where(read).collect():
            fine.setdefault((row["part"], row["bin"] // COARSE), np.zeros(COARSE, np.int64))[row["bin"] % COARSE] = row["n"]
        for rank, (lo, hi, inner) in place.items():
            part, g = found[rank]
            inner -= int(sums[part][g - 1]) if g else 0
            totals = fine[part, g].cumsum()
            slot = int(np.searchsorted(totals, inner, side="right"))
            width = (hi - lo) / bins
            at = g * COARSE + slot
            place[rank] = (lo + at * width, lo + (at + 1) * width, inner - (int(totals[slot - 1]) if slot else 0))
    return {rank: (lo + hi) / 2 for rank, (lo, hi, _) in place.items()}


def cosine_moments(items: DataFrame, item: str = "item_id",
                   embedding: str = "embedding") -> tuple[float, float]:
    """Mean and population deviation of the cosine over all unordered pairs.

    Both follow from sums over single items: the pair sum from the total of the unit
    vectors, the sum of squares from their Gram matrix, so no pair is formed.
    """
    dim = items.select(F.size(embedding)).first()[0]

    def gram(batches):
        total, outer, n, self_sq = np.zeros(dim), np.zeros((dim, dim)), 0, 0.0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            lengths = np.linalg.norm(x, axis=1, keepdims=True)
            u = np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)
            total += u.sum(0)
            outer += u.T @ u
            own = (u * u).sum(1)
            self_sq += (own * own).sum()
            n += len(x)
        slots = np.concatenate([total, outer.ravel(), [n, self_sq]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(slots))), pa.array(slots)], names=["slot", "value"])

    sums = (items.select(F.col(embedding).cast("array<double>"))
            .mapInArrow(gram, "slot long, value double")
            .groupBy("slot").agg(F.sum("value").alias("value")).collect())
    flat = np.zeros(dim + dim * dim + 2)
    for row in sums:
        flat[row["slot"]] = row["value"]
    total, outer = flat[:dim], flat[dim:dim + dim * dim].reshape(dim, dim)
    n, self_sq = flat[-2], flat[-1]
    trace = np.trace(outer)
    pairs = n * (n - 1) / 2
    mean = (total @ total - trace) / 2 / pairs
    square = ((outer * outer).sum() - self_sq) / 2 / pairs
    return float(mean), float(math.sqrt(max(square - mean * mean, 0.0)))
