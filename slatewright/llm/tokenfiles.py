"""Token-id files: documents in doc_id order, coded in checksummed blocks.

A file set is a folder of Parquet files whose rows are segments. A segment holds whole
documents in ascending doc_id order (null first) and a frame of independently coded
blocks (``rangecoder``); segments are ordered by (part, seq).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewright.llm import rangecoder
from slatewright.llm.shared import shuffle_partitions

SEGMENTS = ("part int, seq int, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, "
            "frame binary")
DECODED = "part int, seq int, doc_id bigint, first bigint, ids binary"
END_ID = 0
#: Ids of a segment, to a document's end: what a task holds at once.
SEGMENT_IDS = rangecoder.BLOCK * rangecoder.LANES
#: A blank amid or before other white space may join it in one token.
_JOINED_BLANK = re.compile(r"\s (?:\s|$)|^ ")
_CACHED_PIECES = 500_000
#: Fixed value: the public word pattern of byte-level vocabularies; used for Latin letters, on which all
#: versions of Unicode agree.
_PATTERN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Texts that are looked through together for pieces not met before, and such pieces encoded in one call.
_TEXTS, _JOINED = 200, 200


class PieceEncoder:
    """Whole texts through the tokenizers library, each distinct piece once.

    A token of a byte-level vocabulary with the usual word pattern never spans a blank
    that follows a visible character, so a text is cut before such blanks. Each distinct
    piece, or word of the pattern within it, is encoded once and remembered; those not met
    before are joined and encoded many in a call, where each begins at the one token that
    begins with its blank. Texts that have other runs of white space around blanks, or that may hold special tokens, are
    encoded in a call of their own.
    """

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary must have at most 65536 ids")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.blank = np.zeros(1 << 16, bool)
        self.blank[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self.pieces: dict[str, bytes] = {}
        encoder = self

        class Tails(dict):
            def __missing__(self, word: str) -> bytes:
                self[word] = found = encoder.whole(word)
                return found

        self.tails = Tails()

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encodes these pieces, all different."""
        known, plain, split = self.pieces, {}, []
        for p in pieces:
            if p and p.isprintable():  # white space and controls are not printable
                if p.isalpha() or max(p) >= "\u0250":
                    plain[p] = None
                else:
                    first, *rest = _PATTERN.findall(" " + p)
                    split.append((p, first[1:], rest))
                    if first[1:] not in known:
                        plain[first[1:]] = None
        own = list(plain)
        for k in range(0, len(own), _JOINED):
            self._joined(own[k:k + _JOINED])
        for p, first, rest in split:
            known[p] = known[first] + b"".join(map(self.tails.__getitem__, rest))
        for p in pieces:
            if p not in known:
                known[p] = self.whole(" " + p)

    def _joined(self, pieces: list[str]) -> None:
        joined = " " + " ".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u2")
        begins = np.flatnonzero(self.blank[ids])
        if len(begins) == len(pieces) and not any(s in joined for s in self.specials):
            coded, begins = ids.tobytes(), (2 * begins).tolist()
            self.pieces.update((p, coded[a:b]) for p, a, b in zip(pieces, begins, [*begins[1:], len(coded)], strict=True))
        else:  # of another kind of vocabulary
            self.pieces.update((p, self.whole(" " + p)) for p in pieces)

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 16-bit numbers."""
        if len(self.pieces) >= _CACHED_PIECES:
            self.pieces.clear()
            self.tails.clear()
        cut = [None if _JOINED_BLANK.search(t) or any(s in t for s in self.specials) else t.split(" ") for t in texts]
        known = self.pieces
        new = {p: None for parts in cut if parts for p in parts[1:] if p not in known}
        if new:
            self.learn(list(new))
        get = known.__getitem__
        return [self.whole(t) if parts is None else (self.whole(parts[0]) if parts[0] else b"") + b"".join(map(get, parts[1:]))
                for t, parts in zip(texts, cut, strict=True)]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(1)
def _encoder(tokenizer_json: str) -> PieceEncoder:
    """One a worker, so that its tasks know each other's pieces."""
    return PieceEncoder(tokenizer_json)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, partitions: int | None = None) -> None:
    """Tokenizes ``docs`` (doc_id, text), appends END_ID to each and writes the files.

    Documents are brought into doc_id order by a range shuffle; rows with equal ids are
    ordered by a hash of their text. A null text is empty and gives the end id alone;
    repeated rows are written each; an empty table gives files without segments. The
    tokenizer's definition, of fixed size, is sent along with the job.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(definition), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        texts: list[bytes] = []
        size = 0
        end = np.array([END_ID], "<u2").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, texts, size, seq
            ids = np.frombuffer(b"".join(texts), "<u2")
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([[len(t) // 2 for t in texts]], pa.list_(pa.int64())),
                 pa.array([rangecoder.encode(ids)], pa.binary())],
                names=["part", "seq", "n_ids", "doc_ids", "counts", "frame"])
            doc_ids, texts, size, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for k in range(0, batch.num_rows, _TEXTS):
                own = batch.slice(k, _TEXTS)
                coded = encoder.many([text or "" for text in own.column(1).to_pylist()])
                for doc_id, ids in zip(own.column(0).to_pylist(), coded, strict=True):
                    doc_ids.append(doc_id)
                    texts.append(ids + end)
                    size += len(ids) // 2 + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
        if doc_ids:
            yield flush()

    ordered = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")))
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(path)


def segment_starts(stored: DataFrame) -> DataFrame:
    """(part, seq, start): the ids before each segment, from the segments' sizes alone."""
    sizes = stored.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("part", F.coalesce(F.sum("_ids").over(over), F.lit(0)).alias("_before"))
    return (sizes.withColumn("_own", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
            .join(shifts, "part").select("part", "seq", (F.col("_before") + F.col("_own")).alias("start")))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), and the document's ids, decoded from the files,
    as little-endian 32-bit numbers. A damaged block is an error."""
    stored = spark.read.schema(SEGMENTS).parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                ids = rangecoder.decode(row["frame"].as_buffer().to_pybytes()).astype("<u4")
                doc_ids, counts = row["doc_ids"].as_py(), row["counts"].as_py()
                stops = np.cumsum(counts)
                if int(stops[-1]) != len(ids):
                    raise ValueError("a segment's documents and ids differ in number")
                for a in range(0, len(doc_ids), 1000):
                    own = range(a, min(a + 1000, len(doc_ids)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"].as_py()] * len(own), pa.int32()),
                         pa.array([row["seq"].as_py()] * len(own), pa.int32()),
                         pa.array([doc_ids[i] for i in own], pa.int64()),
                         pa.array([int(stops[i]) - counts[i] for i in own], pa.int64()),
                         pa.array([ids[stops[i] - counts[i]:stops[i]].tobytes() for i in own], pa.binary())],
                        names=["part", "seq", "doc_id", "first", "ids"])

    docs = stored.select("part", "seq", "n_ids", "doc_ids", "counts", "frame").mapInArrow(decoded, DECODED)
    return (docs.join(F.broadcast(segment_starts(stored)) if _few(stored) else segment_starts(stored), ["part", "seq"])
            .select("doc_id", (F.col("start") + F.col("first")).alias("start"), "ids"))


def _few(stored: DataFrame, most: int = 1_000_000) -> bool:
    """Segments are of fixed size, so that many of them stand for some 10^13 ids."""
    return stored.select("part").limit(most + 1).count() <= most


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
