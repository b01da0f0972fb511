"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked ids.

A byte-level vocabulary (A) reads a blank and the text, a piece vocabulary (B) the text, before
which it puts a blank itself; so both cut the same bytes. A and B tokens that share bytes are
linked; where tokens of both end at the same byte, the document is cut into groups.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.llm.shared import settle

#: Text that a task encodes and aligns at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of a document that one lane of the lockstep merging walks through.
LANE_BYTES = 2048
#: Words and ids that a task remembers.
CACHED_WORDS = 400_000
CACHED_IDS = 4_000_000
#: Pairs whose counts a task holds before it hands them on.
HELD_PAIRS = 4_000_000
#: The table of linked pairs is broadcast up to this many pairs of 16 bytes, and joined beyond.
BROADCAST_PAIRS = 1 << 22

#: Fixed value: the public word pattern of byte-level vocabularies.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose classes all versions of Unicode agree.
_SETTLED = re.compile(r"[\x00-\x7f\xa1-\u024f]*")

SLICES = ("slice string, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
          "n_links array<bigint>, hashes array<string>, ends array<bigint>, pairs binary, times binary")
DIGEST = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
          "groups_sha256 string")


@dataclass
class Definitions:
    """What the tasks need to build both tokenizers: files of fixed size, sent along with the job."""

    a_json: str
    b_model: bytes
    ranked: bool  #: every token of A is what its own bytes are merged to, and ids are in the order of the merges

    @staticmethod
    def read(a_path: str, b_path: str) -> Definitions:
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            text, model = a.read(), b.read()
        parsed = json.loads(text)
        own, special = parsed["model"], {t["content"] for t in parsed["added_tokens"]}
        merged = [own["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in own["merges"]]
        in_order = merged == list(range(256, 256 + len(merged)))
        bare = Tokenizer.from_str(json.dumps({**parsed, "pre_tokenizer": None, "added_tokens": []}))
        return Definitions(text, model, in_order and all(
            bare.encode(token, add_special_tokens=False).ids == [i] for token, i in own["vocab"].items() if token not in special))


def byte_alphabet() -> dict[str, int]:
    """Fixed rule of byte-level vocabularies: printable Latin-1 characters stand for their own byte, the other
    bytes for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Words:
    """Both tokenizers' ids of blank-led words, each distinct word encoded once and remembered.

    Neither vocabulary has a token that reaches from a visible character over a blank, so a text is cut
    before single blanks between words. Texts with blanks in or beside other white space that may join
    them in one token, or with white space at an end, are one word.
    """

    def __init__(self, definitions: Definitions) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definitions.a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=definitions.b_model)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = [b""] * self.b.get_piece_size()
        for i in range(len(self.b_bytes)):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        if any(b" " in x.lstrip(b" ") and x.decode("utf-8", "replace").strip() for x in self.a_bytes + self.b_bytes):
            raise ValueError("a vocabulary has tokens that reach from a word over a blank")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.ranked = self._ranked(definitions, alphabet) if definitions.ranked else None
        self._forget()

    @staticmethod
    def _ranked(definitions: Definitions, alphabet: dict[str, int]):
        """The same vocabulary as ranks. Where ids follow the merges and each token is what its bytes are merged to,
        merging the pair with the lowest id of its joined bytes takes the same steps as merging by the list."""
        import tiktoken

        vocabulary = json.loads(definitions.a_json)["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if all(c in alphabet for c in token)}
        return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={**ranks}, special_tokens={})

    def _forget(self) -> None:
        words = self

        class Index(dict):
            def __missing__(self, word: str) -> int:
                self[word] = at = len(self)
                words.new.append(word)
                return at

        self.index, self.new = Index(), []
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.first = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.size = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.right = np.empty(0, bool)

    def cut(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some 2^20 characters at once."""
        if "  " in text or text[0].isspace() or text[-1].isspace() or _amid(text):
            yield [text]
            return
        start = 0
        while len(text) - start > 1 << 20:
            stop = text.find(" ", start + (1 << 20))
            if stop < 0:
                break
            yield text[start:stop].split(" ")
            start = stop + 1
        yield text[start:].split(" ")

    def numbers(self, text: str) -> np.ndarray:
        """The text's words as places in the memory."""
        return np.concatenate([np.fromiter(map(self.index.__getitem__, part), np.int64, len(part)) for part in self.cut(text)])

    def learn(self) -> None:
        """Encodes the words met since the last call."""
        if not self.new:
            return
        wholes = [(" " + w).encode("utf-8", "surrogatepass") for w in self.new]
        sides = (self._encode_a(wholes), self._encode_b())
        right = np.ones(len(wholes), bool)
        for side, (flat, size) in enumerate(sides):
            texts = self.a_bytes if side == 0 else self.b_bytes
            right &= _same(wholes, [texts[i] for i in flat.tolist()], size)
            first = len(self.ids[side]) + np.cumsum(size) - size
            self.ids[side] = np.concatenate([self.ids[side], flat])
            self.first[side] = np.concatenate([self.first[side], first])
            self.size[side] = np.concatenate([self.size[side], size])
        self.right = np.concatenate([self.right, right])
        self.new = []

    def _encode_a(self, wholes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of settled characters are encoded in one call over their joined text, the others by the list of merges."""
        easy = [self.ranked is not None and w == w.strip() and _SETTLED.fullmatch(w) is not None for w in self.new]
        hard = [" " + w for w, e in zip(self.new, easy, strict=True) if not e]
        slow = _flat([e.ids for e in self.a.encode_batch_fast(hard, add_special_tokens=False)])
        if len(hard) == len(wholes):
            return slow
        joined = [w for w, e in zip(wholes, easy, strict=True) if e]
        flat = np.array(self.ranked.encode_ordinary(b"".join(joined).decode()), np.int32)
        stops = np.searchsorted(np.cumsum(self.a_len[flat]), np.cumsum([len(w) for w in joined])) + 1
        fast = flat, np.diff(stops, prepend=0)
        if not hard:
            return fast
        turns = [iter(np.split(ids, np.cumsum(size)[:-1])) for ids, size in (slow, fast)]
        found = [next(turns[e]) for e in easy]
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_b(self) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.b.encode(self.new, num_threads=1))

    def gather(self, words: np.ndarray, side: int) -> np.ndarray:
        """The ids of the words in order."""
        size = self.size[side][words]
        stop = np.cumsum(size)
        return self.ids[side][np.arange(int(size.sum())) + np.repeat(self.first[side][words] - stop + size, size)]

    def trim(self) -> None:
        if len(self.index) > CACHED_WORDS or sum(map(len, self.ids)) > CACHED_IDS:
            self._forget()


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size


def _same(wholes: list[bytes], tokens: list[bytes], size: np.ndarray) -> np.ndarray:
    """Which words are their tokens' joined bytes; usually all, which one comparison shows."""
    lengths = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))])
    stops = np.cumsum(size)
    own = np.fromiter(map(len, wholes), np.int64, len(wholes))
    if (lengths[stops] - lengths[stops - size] == own).all() and b"".join(tokens) == b"".join(wholes):
        return np.ones(len(wholes), bool)
    return np.array([b"".join(tokens[stop - n:stop]) == whole
                     for whole, stop, n in zip(wholes, stops.tolist(), size.tolist(), strict=True)])


def _amid(text: str) -> bool:
    """Is a blank both preceded and followed by other white space, which may join it in one token?"""
    from slatewright.llm.tokenfiles import _JOINED_BLANK

    return _JOINED_BLANK.search(text) is not None


def merge_lockstep(a_end: np.ndarray, b_end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (place in A, place in B, do both end here?) of two token rows over the same bytes, in order.

    ``a_end`` and ``b_end`` are the tokens' end bytes; ``bounds``, ascending from 0, deals the bytes to lanes. One
    state vector holds the A and B places of all lanes. Each step links every lane's two tokens and moves on the one
    that ends first, or both; lanes that reach their bound leave the vector.
    """
    at, stop = bounds[:-1], bounds[1:]
    a, b = np.searchsorted(a_end, at, "right"), np.searchsorted(b_end, at, "right")
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(a):
        ends_a, ends_b = a_end[a], b_end[b]
        cut = ends_a == ends_b
        steps.append((a, b, cut))
        reached = np.minimum(ends_a, ends_b)
        a, b = a + (ends_a <= ends_b), b + (ends_b <= ends_a)
        left = reached < stop
        if not left.all():
            a, b, stop = a[left], b[left], stop[left]
    if not steps:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    a, b, cut = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.empty(len(a_end) + len(b_end), np.int64)
    order.fill(-1)
    order[a + b] = np.arange(len(a))  # of a lane's tokens one at least moves on, so sums are distinct and ascend
    order = order[order >= 0]
    return a[order], b[order], cut[order]


def lanes(ends: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Lane bounds: the documents' ends, and in long documents every LANE_BYTES, moved on to the next byte where an
    A or a B token ends."""
    total = int(ends[-1]) if len(ends) else 0
    marks = np.arange(LANE_BYTES, total, LANE_BYTES)
    marks = np.minimum(a_end[np.searchsorted(a_end, marks)], b_end[np.searchsorted(b_end, marks)])
    return np.unique(np.concatenate([[0], marks, ends]))


class Aligner:
    """Texts to their groups, links and linked pairs."""

    def __init__(self, definitions: Definitions) -> None:
        self.words = Words(definitions)
        self.base = len(self.words.b_bytes)
        #: ids of A followed by "," or "|", ids of B followed by "," or ";"
        self.written = [f"{i}{mark}" for size, last in ((len(self.words.a_bytes), "|"), (self.base, ";"))
                        for i in range(size) for mark in (",", last)]

    def __call__(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """Of each text: n_a, n_b, n_groups, n_links, hash of its groups, and the end of its distinct linked pairs
        in ``pairs`` (A id * size of B + B id) with their ``times``."""
        words = self.words
        words.trim()
        n = len(texts)
        numbers = [words.numbers(t) if t else None for t in texts]
        words.learn()
        used = [k for k in range(n) if numbers[k] is not None and words.right[numbers[k]].all()]
        out: dict = {x: [0] * n for x in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"hashes": [""] * n, "ends": [0] * n, "pairs": np.empty(0, np.int64), "times": np.empty(0, np.int64)}
        if not used:
            return out
        own = [numbers[k] for k in used]
        a, b = (words.gather(np.concatenate(own), side) for side in (0, 1))
        n_a, n_b = (np.array([int(words.size[side][x].sum()) for x in own]) for side in (0, 1))
        a_end, b_end = np.cumsum(words.a_len[a]), np.cumsum(words.b_len[b])
        ends = a_end[np.cumsum(n_a) - 1]
        at_a, at_b, cut = merge_lockstep(a_end, b_end, lanes(ends, a_end, b_end))
        doc = np.searchsorted(np.cumsum(n_a), at_a, "right")
        n_links, n_groups = np.bincount(doc, minlength=len(used)), np.bincount(doc[cut], minlength=len(used))
        codes, times = np.unique((doc << 48) + a[at_a].astype(np.int64) * self.base + b[at_b], return_counts=True)
        doc_ends = np.searchsorted(codes, np.arange(1, len(used) + 1) << 48)
        out["pairs"], out["times"] = codes & ((1 << 48) - 1), times
        hashes = self._hashes(a, b, n_a + n_b, at_a[cut], at_b[cut])
        places = np.zeros(n, np.int64)
        for j, k in enumerate(used):
            out["n_a"][k], out["n_b"][k] = int(n_a[j]), int(n_b[j])
            out["n_groups"][k], out["n_links"][k], out["hashes"][k] = int(n_groups[j]), int(n_links[j]), hashes[j]
            places[k] = doc_ends[j]
        out["ends"] = np.maximum.accumulate(places).tolist()
        return out

    def _hashes(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """Hashes of the written groups, given the last A and B token of each."""
        written = np.empty(len(a) + len(b), np.int64)
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a] = ends_b[last_b] = 1
        # a group's A tokens follow all B tokens of earlier groups, its B tokens follow its own A tokens as well
        written[np.arange(len(a)) + np.repeat(last_b + 1 - size_b, size_a)] = 2 * a + ends_a
        written[np.arange(len(b)) + np.repeat(last_a + 1, size_b)] = 2 * (len(self.words.a_bytes) + b) + ends_b
        parts = list(map(self.written.__getitem__, written.tolist()))
        stops = np.cumsum(n).tolist()
        return [hashlib.sha256("".join(parts[i:j])[:-1].encode()).hexdigest() for i, j in zip([0, *stops], stops, strict=False)]


def align(docs: DataFrame, definitions: Definitions) -> DataFrame:
    """``docs`` (doc_id, text) aligned and written in slices of some SLICE_BYTES: per document its counts and the hash
    of its groups, and all its distinct linked pairs with how often they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, part, seq = Aligner(definitions), TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, size, seq
            found = aligner(texts)
            row = pa.RecordBatch.from_pydict(
                {"slice": [f"{part}:{seq}"], "doc_ids": [ids], **{k: [found[k]] for k in ("n_a", "n_b", "n_groups", "n_links")},
                 "hashes": [found["hashes"]], "ends": [found["ends"]], "pairs": [found["pairs"].astype("<u8").tobytes()],
                 "times": [found["times"].astype("<u4").tobytes()]}, schema=_ARROW_SLICES)
            ids, texts, size, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= SLICE_BYTES:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return settle(rows.mapInArrow(run, SLICES), "aligned")


_ARROW_SLICES = pa.schema([
    ("slice", pa.string()), ("doc_ids", pa.list_(pa.int64())), *[(x, pa.list_(pa.int64())) for x in ("n_a", "n_b", "n_groups", "n_links")],
    ("hashes", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())), ("pairs", pa.binary()), ("times", pa.binary())])


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """a, b, docs: in how many documents the ids are linked. Each task adds up what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                new, n = np.unique(np.frombuffer(raw.as_buffer(), "<i8"), return_counts=True)
                keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "docs"])
                    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "docs"])

    sums = aligned.select("pairs").mapInArrow(run, "pair bigint, docs bigint").groupBy("pair").agg(F.sum("docs").alias("docs"))
    return settle(sums.select(F.floor(F.col("pair") / n_b).cast("long").alias("a"), F.pmod("pair", F.lit(n_b)).alias("b"), "docs"),
                  "pair-counts")


def corpus_digest(docs: DataFrame, definitions: Definitions, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text).

    Null and empty texts, and those whose A or B bytes are not a blank and the text, have zeros and ''. Repeated rows
    and rows without doc_id are documents of their own; other columns are left aside; an empty table gives no rows.
    """
    import sentencepiece

    n_a = max(json.loads(definitions.a_json)["model"]["vocab"].values()) + 1
    n_b = sentencepiece.SentencePieceProcessor(model_proto=definitions.b_model).get_piece_size()
    aligned = align(docs, definitions)
    return digest(aligned, pair_counts(aligned, n_b), n_a, n_b, broadcast_pairs)


def digest(aligned: DataFrame, counts: DataFrame, n_a: int, n_b: int, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document its counts, how many of its links have their A id's highest pair count, and the sum of its links'
    pair counts.

    The highest count of each A id is one number an id of the vocabulary. The pairs' table is sent to all tasks if it
    has at most ``broadcast_pairs`` rows. Otherwise each slice asks for each of its pairs once, by a shuffled join, and
    gets its own list back; a pair then has at most as many rows as there are slices.
    """
    spark = aligned.sparkSession
    highest = np.zeros(n_a, np.int64)
    for row in counts.groupBy("a").agg(F.max("docs").alias("docs")).collect():
        highest[row.a] = row.docs
    few = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    if few:
        own = counts.select((F.col("a") * n_b + F.col("b")).alias("pair"), "docs").toArrow()
        keys = own.column("pair").to_numpy()
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order], own.column("docs").to_numpy()[order]))
        rows = aligned
    else:
        table = None
        asked = aligned.select("slice", F.explode(_pair_list(aligned)).alias("pair"))
        known = counts.select((F.col("a") * n_b + F.col("b")).alias("pair"), "docs")
        answers = asked.join(known, "pair").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("pair", "docs"))).alias("_own"))
        rows = (aligned.join(answers, "slice", "left")
                .select(*aligned.columns, F.transform("_own", lambda x: x["pair"]).alias("_keys"),
                        F.transform("_own", lambda x: x["docs"]).alias("_docs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for k in range(batch.num_rows):
                row = {x: batch.column(i)[k] for i, x in enumerate(names)}
                pairs, times = np.frombuffer(row["pairs"].as_buffer(), "<i8"), np.frombuffer(row["times"].as_buffer(), "<u4").astype(np.int64)
                if table is not None:
                    keys, docs = table.value
                elif row["_keys"].is_valid:
                    keys, docs = (row[x].values.to_numpy(zero_copy_only=False) for x in ("_keys", "_docs"))
                else:
                    keys = docs = np.empty(0, np.int64)
                own = docs[np.searchsorted(keys, pairs)]
                best = own == highest[pairs // n_b]
                ends = np.concatenate([[0], np.asarray(row["ends"].as_py(), np.int64)])
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (best * times, own * times)]
                n_best, count_sum = (x[ends[1:]] - x[ends[:-1]] for x in sums)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, *[row[x].values for x in ("n_a", "n_b", "n_groups", "n_links")],
                     pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), row["hashes"].values],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, DIGEST)


def _pair_list(aligned: DataFrame):
    """A slice's distinct pairs as a column, taken from their bytes."""

    @F.pandas_udf("array<bigint>")
    def listed(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: np.unique(np.frombuffer(x, "<i8")))

    return listed(aligned["pairs"])
