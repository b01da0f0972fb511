"""Corpus-wide questions about fingerprints, asked batch by batch.

Documents are stored once as batches of a few MB (``store``). A task turns a batch into
fingerprints, sorts and dedups them, and sends each bucket its slice (``ask``); a bucket
sees at most one copy of a fingerprint from each batch, however often the text repeats,
so no key is hot. The bucket answers with one number per fingerprint; answers meet the
batches again by batch id, without moving the texts (``answered``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.llm.shared import shared_path, shuffle_partitions

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Text in one bucket of stored batches, which one task reads.
STORED_BYTES = 64 << 20
CHUNK = 1 << 18
BATCHES = "batch bigint, n_bytes bigint, ids array<bigint>, ends array<bigint>, data binary"
SENT = "bucket int, kind int, batch bigint, keys binary, ids binary, note binary"
REPLIES = "batch bigint, kind int, bucket int, answer binary"

_MASK = (1 << 64) - 1


def _random_words(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_WORDS = _random_words(20240611, 256)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if (odd, n) not in _powers:
        tables = []
        for base in (odd, pow(odd, -1, 1 << 64)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[odd, n] = tuple(tables)
    return _powers[odd, n]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(elements: np.ndarray, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """64-bit fingerprints of the ``width`` elements (bytes, or 64-bit words) from each of the ascending ``at``."""
    out = np.empty(len(at), np.uint64)
    fwd, back = _power_tables(_ODD[which], CHUNK + width + 1)
    cut = np.searchsorted(at, np.arange(0, len(elements) + CHUNK, CHUNK))
    for c in range(len(cut) - 1):
        own = at[cut[c]:cut[c + 1]]
        if len(own):
            part = elements[c * CHUNK:(c + 1) * CHUNK + width]
            values = BYTE_WORDS[part] if part.dtype == np.uint8 else part
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values * fwd[:len(part)], out=sums[1:])
            own = own - c * CHUNK
            out[cut[c]:cut[c + 1]] = (sums[own + width] - sums[own]) * back[own]
    return scrambled(out)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and the words' end index by document."""
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[:-1] = space
    first = np.ones(len(data) + 1, bool)
    first[1:] = edge[:-1]
    first[ends] = True  # a document's end ends its last word
    begin = np.flatnonzero(first[:-1] & ~space)
    last = np.zeros(len(data) + 1, bool)
    last[1:] = ~space
    stop = np.flatnonzero(last & (edge | first))
    return begin, stop, np.searchsorted(begin, ends)


def word_hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of any length."""
    out = np.empty(len(begin), np.uint64)
    fwd, back = _power_tables(_ODD[1], CHUNK + 1)
    i = 0
    while i < len(begin):
        a = int(begin[i])
        j = int(np.searchsorted(stop, a + CHUNK, "right"))
        if j <= i:  # one word longer than a chunk
            out[i] = zlib.crc32(data[a:stop[i]].tobytes()) | zlib.adler32(data[a:stop[i]].tobytes()) << 32
            i += 1
            continue
        part = data[a:stop[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_WORDS[part] * fwd[:len(part)], out=sums[1:])
        b, e = begin[i:j] - a, stop[i:j] - a
        out[i:j] = (sums[e] - sums[b]) * back[b] + (e - b).astype(np.uint64)
        i = j
    return scrambled(out)


def per_element(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element: its place in its document, and how many follow there, itself included."""
    lens = np.diff(ends, prepend=0)
    kind = np.int32 if len(ends) == 0 or ends[-1] < 1 << 31 else np.int64
    place = np.arange(ends[-1] if len(ends) else 0, dtype=kind) - np.repeat((ends - lens).astype(kind), lens)
    return place, np.repeat(lens.astype(kind), lens) - place


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n elements lie in one of the windows from the distinct ``starts``."""
    step = np.zeros(n + 1, np.int32)
    step[starts] += 1
    step[starts + width] -= 1
    return np.cumsum(step[:-1]) > 0


def store(docs: DataFrame, name: str, batch_bytes: int = BATCH_BYTES, path: str | None = None) -> DataFrame:
    """Batches of whole documents, written once and bucketed by batch id, below the shared folder (at ``path``, so that
    it can be discarded once what was asked of them is stored). Buckets grow in number with the texts.

    A row holds doc_ids (null stays null), the texts' end offsets and their bytes (a null
    text has none). A document longer than ``batch_bytes`` is a batch of its own.
    """
    spark = docs.sparkSession

    def pack(arrow_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, parts, size, seq
            row = pa.RecordBatch.from_pydict(
                {"batch": [base + seq], "n_bytes": [size], "ids": [ids],
                 "ends": [np.cumsum([len(x) for x in parts], dtype=np.int64)], "data": [b"".join(parts)]},
                schema=pa.schema([("batch", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())),
                                  ("ends", pa.list_(pa.int64())), ("data", pa.binary())]))
            ids, parts, size, seq = [], [], 0, seq + 1
            return row

        for batch in arrow_batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if ids and size + len(text) > batch_bytes:
                    yield flush()
                ids.append(doc_id.as_py())
                parts.append(text)
                size += len(text)
        if ids:
            yield flush()

    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, BATCHES)
    path = path or shared_path(spark, name)
    table = "llm_" + path.rsplit("/", 1)[-1].replace("-", "_")
    (rows.write.format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(max(1, shuffle_partitions(spark), -(-total // STORED_BYTES)), "batch").saveAsTable(table))
    return spark.table(table)


def bucket_count(batches: DataFrame, bytes_per_input_byte: float) -> int:
    """Buckets of about BUCKET_BYTES for what is sent about each byte of text; one sum over a small column."""
    total = batches.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, shuffle_partitions(batches.sparkSession), round(total * bytes_per_input_byte / BUCKET_BYTES))


def sorted_keys(first: np.ndarray, second: np.ndarray, n_buckets: int):
    """Distinct keys by (bucket, key): keys, bucket bounds, each row's key, and a first row of each key.

    The bucket comes from the second fingerprint, so two texts are taken as equal only if
    64 bits and the bucket agree; buckets grow in number with the data, so the chance of
    a false match does not.
    """
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    heads = order[new]
    bucket = ((second[heads] >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty(len(heads), np.int64)
    rank[by_bucket] = np.arange(len(heads))
    own = np.empty(len(first), np.int64)
    own[order] = rank[np.cumsum(new) - 1]
    bounds = np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1))
    return first[heads][by_bucket], bounds, own, heads[by_bucket]


def slices(batch: int, keys: np.ndarray, bounds: np.ndarray, ids: np.ndarray | None = None,
           note: bytes | None = None, kind: int = 0) -> pa.RecordBatch:
    """What a batch sends; ``note`` comes back to it with the answers. Keys meet keys of their kind."""
    full = np.flatnonzero(np.diff(bounds))
    cut = [(int(bounds[b]), int(bounds[b + 1])) for b in full]
    columns = [list(map(int, full)), [keys[a:b].tobytes() for a, b in cut],
               [None if ids is None else ids[a:b].tobytes() for a, b in cut], [None] * len(cut)]
    if note is not None:
        for column, x in zip(columns, (batch % (len(bounds) - 1), None, None, note), strict=True):
            column.append(x)
    n = len(columns[0])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([batch] * n, pa.int64()),
         *(pa.array(c, pa.binary()) for c in columns[1:])],
        names=["bucket", "kind", "batch", "keys", "ids", "note"])


def repeated(keys: np.ndarray, batch: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Answer: is the key in another batch as well?"""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def not_first(keys: np.ndarray, batch: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Answer: does another batch have the key with a smaller id (equal ids: a smaller batch)?"""
    order = np.lexsort((batch, ids, keys))
    flag = np.zeros(len(keys), bool)
    flag[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return flag


def copies(keys: np.ndarray, batch: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Answer: 0 if no other batch has the key, 1 if this one has it first, 2 if another has (as in ``not_first``)."""
    return not_first(keys, batch, ids).astype(np.uint8) + repeated(keys, batch, ids)


def holders(keys: np.ndarray, batch: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Answer: the summed counts of the key over all batches, up to 255."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=ids[order].astype(np.float64)) if len(keys) else np.zeros(0)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.minimum(total, 255).astype(np.uint8)[group]
    return out


def ask(sent: DataFrame, n_buckets: int, *answers: Callable, ids_type: str = "int64") -> DataFrame:
    """Buckets answer what batches sent, keys of kind k by ``answers[k]``; the answers of a batch come back as
    one row."""

    def respond(arrow_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        asked: dict[int, list[tuple]] = {}
        for sent_rows in arrow_batches:  # keys stay where Arrow holds them
            bucket, kind, batch = (sent_rows.column(i).to_pylist() for i in range(3))
            for k in range(sent_rows.num_rows):
                keys, ids, note = (sent_rows.column(i)[k] for i in (3, 4, 5))
                if note.is_valid:
                    out.append((batch[k], 0, -1, note.as_py()))
                if keys.is_valid:
                    asked.setdefault(kind[k], []).append(
                        (batch[k], bucket[k], np.frombuffer(keys.as_buffer(), np.uint64),
                         np.frombuffer(ids.as_buffer(), ids_type) if ids.is_valid else None))
        for kind, answer in enumerate(answers):
            own = sorted(asked.pop(kind, ()), key=lambda x: x[0])
            if not own:
                continue
            sizes = [len(x[2]) for x in own]
            ids = None if own[0][3] is None else np.concatenate([x[3] for x in own])
            flags = answer(np.concatenate([x[2] for x in own]), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), ids)
            for (batch_id, bucket_id, *_), part in zip(own, np.split(flags, np.cumsum(sizes)[:-1]), strict=True):
                raw = (np.packbits(part) if part.dtype == bool else part).tobytes()
                out.append((batch_id, kind, bucket_id, zlib.compress(raw, 1)))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                         names=["batch", "kind", "bucket", "answer"])

    replies = sent.groupBy("bucket").applyInArrow(_by_group(respond), REPLIES)
    return replies.groupBy("batch").agg(F.collect_list(F.struct("kind", "bucket", "answer")).alias("answers"))


def _by_group(respond):
    def group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(respond(iter(table.to_batches()))))
    return group


def answered(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Batches with their answers. Both lie by batch id, so only the answers are shuffled."""
    return batches.join(replies, "batch", "left")


def read_answers(answers: list | None, bounds: np.ndarray, bits: bool = True, kind: int = 0) -> np.ndarray:
    """The answers in the order of the keys that were sent."""
    n = int(bounds[-1])
    out = np.zeros(n, bool if bits else np.uint8)
    for entry in answers or ():
        b = entry["bucket"]
        if b >= 0 and entry["kind"] == kind:
            raw = np.frombuffer(zlib.decompress(entry["answer"]), np.uint8)
            size = int(bounds[b + 1] - bounds[b])
            out[bounds[b]:bounds[b + 1]] = np.unpackbits(raw, count=size).astype(bool) if bits else raw
    return out


def note_of(answers: list | None) -> bytes | None:
    return next((x["answer"] for x in answers or () if x["bucket"] == -1), None)


def each_batch(rows: Iterator[pa.RecordBatch]):
    """(batch, ids as list, ends, data, answers) of one stored batch after the other."""
    for arrow in rows:
        names = arrow.schema.names
        for k in range(arrow.num_rows):
            ends = np.asarray(arrow.column(names.index("ends"))[k].values, dtype=np.int64)
            data = np.frombuffer(arrow.column(names.index("data"))[k].as_buffer(), np.uint8)
            answers = arrow.column(names.index("answers"))[k].as_py() if "answers" in names else None
            yield (arrow.column(names.index("batch"))[k].as_py(), arrow.column(names.index("ids"))[k].as_py(),
                   ends, data, answers)
