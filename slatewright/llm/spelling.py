"""Spelling variants: words that differ by one code point, found over a dictionary of trie-node pairs.

All words stand in two tries, forwards and reversed, whose nodes are numbered. A prefix and a suffix of
a word are a pair of integers. Two words of one length that differ at a place share the pair of nodes
around it; if a code point of one word is left out, the pair around the gap is a pair that cuts the other
word in two. Equal pairs are equal strings, so a join of the pairs gives exactly the near words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.llm.shared import settle

#: Words of at least this many code points that occur at least this often are grouped.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A near word is a word's form if it occurs this many times as often.
FORM_RATIO = 10
#: One run of letters in so many is misspelt before counting (see ``variant``).
DAMAGE = 31
#: Words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Code points of the words in one segment of a sorted list.
SEGMENT_POINTS = 1 << 19
#: Words whose pairs are handed on at once.
CHUNK_WORDS = 8192

_RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_SEGMENTS = "part bigint, seq int, words array<string>, keys array<bigint>, counts array<bigint>, nodes binary, sizes array<int>"
_PAIRS = "p bigint, s bigint, id bigint, n bigint, kind tinyint"
#: Kinds of pairs: around a left-out code point (the first of a run of equal ones, or a further one), or a cut.
_FIRST, _FURTHER, _CUT = 0, 1, 2


def variant(run: str, doc_crc: int) -> str:
    """``run`` without one code point, if the crc32 of "<doc_id>:<run>" is a multiple of DAMAGE; else ``run``."""
    h = zlib.crc32(run.encode(), doc_crc)
    return run if h % DAMAGE else run[:(i := h % len(run))] + run[i + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the maximal runs of letters of all texts, A to Z in lower case, one in DAMAGE misspelt, that are long
    and frequent enough. Tasks add up what they read before the shuffle; a document without id has the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                lowered = text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")  # of bytes, lower() takes A to Z alone
                for word, n in Counter(_RUNS.findall(lowered)).items():
                    held[variant(word, start)] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n bigint")
    return (counted.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def segments(words: DataFrame, name: str, order: str) -> DataFrame:
    """``words`` (word, key, n, nodes: 64-bit integers as bytes) in the order of ``order``, packed into rows of some
    SEGMENT_POINTS, numbered by part and seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, size = TaskContext.get().partitionId(), 0, 0
        columns: list[list] = [[], [], [], []]

        def flush() -> pa.RecordBatch:
            nonlocal seq, size, columns
            row = [pa.array([part], pa.int64()), pa.array([seq], pa.int32()), pa.array([columns[0]], pa.list_(pa.string())),
                   pa.array([columns[1]], pa.list_(pa.int64())), pa.array([columns[2]], pa.list_(pa.int64())),
                   pa.array([b"".join(columns[3])], pa.binary()), pa.array([[len(x) // 8 for x in columns[3]]], pa.list_(pa.int32()))]
            columns, seq, size = [[], [], [], []], seq + 1, 0
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "words", "keys", "counts", "nodes", "sizes"])

        for batch in batches:
            for values in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for column, x in zip(columns, values, strict=True):
                    column.append(x if x is not None else b"")
                size += len(values[0])
                if size >= SEGMENT_POINTS:
                    yield flush()
        if columns[0]:
            yield flush()

    return settle(words.orderBy(order).select("word", "key", "n", "nodes").mapInArrow(run, _SEGMENTS), name)


def _walk(words: list[str], path: list[int], new: int) -> Iterator[list[int]]:
    """The nodes of each word's prefixes of 1, 2, ... code points, given the path of the word before the first one
    and its own shared nodes; new nodes are numbered from ``new`` in the order of a walk through the trie."""
    before = None
    for word in words:
        kept = len(path) if before is None else shared_prefix(before, word)
        path = [*path[:kept], *range(new, new + len(word) - kept)]
        new += len(word) - kept
        before = word
        yield path


def first_nodes(stored: DataFrame) -> dict[tuple[int, int], tuple[int, int, list[int]]]:
    """Of each segment: words before it, the first new node's number, and the nodes its first word shares with the
    word before. Like the bounds of a range shuffle this is a few numbers a segment, so it's put together here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, seq, words = (batch.column(i)[k].as_py() for i in range(3))
                path, new = [], 0
                for path in _walk(words, [], 0):  # as if nothing were shared with earlier segments
                    new = max(new, path[-1] + 1) if path else new  # the empty word has no node of its own
                yield pa.RecordBatch.from_pydict(
                    {"part": [part], "seq": [seq], "n": [len(words)], "new": [new], "head": [words[0]], "tail": [words[-1]], "path": [path]},
                    schema=pa.schema([("part", pa.int64()), ("seq", pa.int32()), ("n", pa.int64()), ("new", pa.int64()),
                                      ("head", pa.string()), ("tail", pa.string()), ("path", pa.list_(pa.int64()))]))

    ends = stored.select("part", "seq", "words").mapInArrow(
        run, "part bigint, seq int, n bigint, new bigint, head string, tail string, path array<bigint>")
    out: dict = {}
    before, nodes, tail, path = 0, 1, "", []  # node 0 is the root
    for row in sorted(ends.collect()):
        kept = shared_prefix(tail, row.head)
        shared = path[:kept]
        out[row.part, row.seq] = before, nodes, shared
        # own numbers below len(head) are the head's nodes; those it shares are older, the others move down
        path = [shared[x] if x < kept else nodes + x - kept for x in row.path]
        before, nodes, tail = before + row.n, nodes + row.new - kept, row.tail
    return out


def numbered(stored: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """``emit`` over (place, word, key, n, nodes stored with it, own nodes) of the words of each segment."""
    starts = first_nodes(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {x: batch.column(i)[k] for i, x in enumerate(batch.schema.names)}
                before, new, shared = starts[row["part"].as_py(), row["seq"].as_py()]
                words, keys, counts, sizes = (row[x].as_py() for x in ("words", "keys", "counts", "sizes"))
                older = np.frombuffer(row["nodes"].as_buffer(), "<i8")
                stops = np.cumsum(sizes)
                yield from emit((before + i, word, keys[i], counts[i], older[stops[i] - sizes[i]:stops[i]], path)
                                for i, (word, path) in enumerate(zip(words, _walk(words, shared, new), strict=True)))

    return stored.mapInArrow(run, schema)


def _chunks(rows: Iterator) -> Iterator[list]:
    chunk: list = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == CHUNK_WORDS:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def _forward(rows: Iterator) -> Iterator[pa.RecordBatch]:
    """word reversed, its place as key, n, and its nodes with the root."""
    for chunk in _chunks(rows):
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[1][::-1] for r in chunk], pa.string()), pa.array([r[0] for r in chunk], pa.int64()),
             pa.array([r[3] for r in chunk], pa.int64()), pa.array([np.array([0, *r[5]], "<i8").tobytes() for r in chunk], pa.binary())],
            names=["word", "key", "n", "nodes"])


def _pairs(rows: Iterator) -> Iterator[pa.RecordBatch]:
    """The pairs of each word: one around each code point left out, one for each cut."""
    for chunk in _chunks(rows):
        size = np.array([len(r[1]) for r in chunk])
        word = np.repeat(np.arange(len(chunk)), size + 1)
        stop = np.cumsum(size + 1)
        place = np.arange(stop[-1]) - np.repeat(stop - size - 1, size + 1)  # 0 .. length of each word
        forward = np.concatenate([r[4] for r in chunk])
        backward = np.concatenate([[0, *r[5]][::-1] for r in chunk])  # node of the suffix from each place
        letters = np.frombuffer("".join(r[1][::-1] + "\0" for r in chunk).encode("utf-32-le"), "<u4")
        gap = place < size[word]
        further = np.zeros(len(letters), bool)
        further[1:] = letters[1:] == letters[:-1]
        at = np.flatnonzero(gap)
        kind = np.where(further[at] & (place[at] > 0), _FURTHER, _FIRST)
        columns = [np.concatenate([forward[at], forward]), np.concatenate([backward[at + 1], backward])]
        words = np.concatenate([word[at], word])
        ids, counts = np.array([r[2] for r in chunk])[words], np.array([r[3] for r in chunk])[words]
        kinds = np.concatenate([kind, np.full(len(word), _CUT)]).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, ids, counts, kinds)], names=["p", "s", "id", "n", "kind"])


def _near(p: np.ndarray, s: np.ndarray, ids: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the rows of whole pairs, sorted by pair: id, how many near words the pair gives it, and the first of them (by
    n descending, then id). A pair has at most one cut word and as many others as there are letters."""
    head = np.ones(len(p), bool)
    head[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(head) - 1
    total = np.bincount(group)
    keep = total[group] > 1
    group, ids, n, kind = group[keep], ids[keep], n[keep], kind[keep]
    group = np.unique(group, return_inverse=True)[1] if len(group) else group
    order = np.lexsort((ids, -n, group))
    group, ids, n, kind = group[order], ids[order], n[order], kind[order]
    groups = int(group[-1]) + 1 if len(group) else 0
    others = np.bincount(group[kind != _CUT], minlength=groups)
    firsts = np.bincount(group[kind == _FIRST], minlength=groups)

    def leading(mask: np.ndarray, skip: int) -> np.ndarray:
        """Row of the group's first (or, after ``skip``, next) one in ``mask``, or -1."""
        rows = np.flatnonzero(mask)
        at = np.searchsorted(group[rows], np.arange(groups)) + skip
        found = np.full(groups, -1)
        inside = at < len(rows)
        inside[inside] = group[rows[at[inside]]] == np.flatnonzero(inside)
        found[inside] = rows[at[inside]]
        return found

    gaps = kind != _CUT
    best, second, shorter, longer = leading(gaps, 0), leading(gaps, 1), leading(kind == _CUT, 0), leading(kind == _FIRST, 0)
    rows = np.arange(len(group))
    replaced = np.where(best[group] == rows, second[group], best[group])  # sorted rows: the smaller row comes first
    removed = np.where(kind == _FIRST, shorter[group], -1)
    none = len(group)
    choice = np.where(gaps, np.minimum(np.where(replaced < 0, none, replaced), np.where(removed < 0, none, removed)),
                      np.where(longer[group] < 0, none, longer[group]))
    count = np.where(gaps, others[group] - 1 + ((kind == _FIRST) & (shorter[group] >= 0)), firsts[group])
    real = count > 0
    choice = choice[real]
    return ids[real], count[real], n[choice], ids[choice]


def near_words(pairs: DataFrame) -> DataFrame:
    """id, n_near, best_n, best: how many near words, and the first of them. All rows of a pair lie in one task, sorted,
    and are compared as arrays; a pair that reaches over a batch's end waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.int8)]

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _near(*columns)], names=["id", "n_near", "best_n", "best"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(left)]
            open_pair = int(np.searchsorted((columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]), True))
            left = [x[open_pair:] for x in columns]
            if open_pair:
                yield found([x[:open_pair] for x in columns])
        if len(left[0]):
            yield found(left)

    by_pair = pairs.repartition("p", "s").sortWithinPartitions("p", "s")
    rows = by_pair.mapInArrow(run, "id bigint, n_near bigint, best_n bigint, best bigint")
    first = F.max(F.struct(F.col("best_n").alias("n"), (-F.col("best")).alias("id")))
    return (rows.groupBy("id").agg(F.sum("n_near").alias("n_near"), first.alias("_first"))
            .select("id", "n_near", F.col("_first.n").alias("best_n"), (-F.col("_first.id")).alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: where the forms (id, form) lead in the end. Each round doubles the steps; as a form occurs
    FORM_RATIO times as often as its word, the longest way grows with the logarithm of the count."""
    ways = settle(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = ways.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        moved = settle(ways.join(further, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if moved.where("_moved").isEmpty():
            return moved.drop("_moved")
        ways = moved.drop("_moved")


def variants(counts: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of ``counts`` (word, n; words are distinct).

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form is its near
    word of largest n (ties: the first in code-point order), if that n is FORM_RATIO times its own; the root is where
    forms lead. Words of any length, the empty one and any characters are treated alike; null words are left out; an
    empty table gives no rows.
    """
    words = counts.where("word IS NOT NULL").select("word", F.lit(0).cast("long").alias("key"), "n", F.lit(None).cast("binary").alias("nodes"))
    ordered = segments(words, "words", "word")
    forward = numbered(ordered, _forward, "word string, key bigint, n bigint, nodes binary")
    backward = segments(forward, "reversed-words", "word")
    near = near_words(numbered(backward, _pairs, _PAIRS))
    own = settle(backward.select(F.explode(F.arrays_zip("words", "keys", "counts")).alias("_w"))
                 .select(F.col("_w.keys").alias("id"), F.reverse("_w.words").alias("word"), F.col("_w.counts").alias("n"))
                 .join(near, "id", "left"), "near-words")
    forms = own.where(F.col("best_n") >= F.lit(FORM_RATIO) * F.col("n")).select("id", F.col("best").alias("form"))
    ends = roots(forms)
    ways = forms.join(ends, "id")
    named = own.select("id", F.col("word").alias("_word"), F.col("n").alias("_n"))
    ways = (ways.join(named.withColumnRenamed("id", "form").withColumnRenamed("_word", "form_word").withColumnRenamed("_n", "form_n"), "form")
            .join(named.select(F.col("id").alias("root"), F.col("_word").alias("root_word")), "root"))
    return (own.join(ways.select("id", "form_word", "form_n", "root_word"), "id", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def grouped(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text); null texts have none, repeated rows count as often."""
    return variants(settle(word_counts(docs), "word-counts"))
