"""Exact substring deduplication by difference-cover anchors.

A difference cover D of period v has, for any two residues a and b, a shift s < v with
(a + s) mod v and (b + s) mod v both in D. So two equal windows of ``width`` elements
hold equal anchors of width - v + 1 elements at cover positions of their documents,
wherever they lie. Only anchors are compared corpus-wide; windows over anchors that
repeat are then compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slatewright.llm import batches as B



@lru_cache
def perfect_cover(q: int) -> tuple[int, ...]:
    """A difference cover of q + 1 residues modulo q * q + q + 1, q prime (Singer's rule).

    The powers of a generator of GF(q^3) that fall into a plane over GF(q) form it.
    """
    period = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):  # x^3 = a x^2 + b x + c
        power, plane = (0, 0, 1), []
        for i in range(period):
            if power[0] == 0:
                plane.append(i)
            x2, x1, x0 = power
            power = ((x1 + a * x2) % q, (x0 + b * x2) % q, c * x2 % q)
        if len(plane) == q + 1 and len({(x - y) % period for x in plane for y in plane}) == period:
            return tuple(plane)
    raise ValueError("q must be prime")


def cover_for(width: int, least: int) -> tuple[int, np.ndarray]:
    """The longest period whose anchors keep at least ``least`` elements, with its residues as a mask."""
    q = max((q for q in (2, 3, 5, 7, 11, 13, 17) if width - q * q - q >= least), default=0)
    period = q * q + q + 1
    mask = np.zeros(period, bool)
    mask[list(perfect_cover(q)) if q else [0]] = True
    return period, mask


def _anchors(elements: np.ndarray, ends: np.ndarray, width: int, period: int, mask: np.ndarray):
    """Cover positions of windows that fit into their document, and their anchors' fingerprints."""
    place, left = B.per_element(ends)
    anchor = width - period + 1
    at = np.flatnonzero(mask[place % period] & (left >= anchor))
    return at, anchor


def _windows(at: np.ndarray, ends: np.ndarray, width: int, period: int) -> np.ndarray:
    """Starts of the windows that hold an anchor from ``at`` within their document."""
    n = int(ends[-1]) if len(ends) else 0
    place, left = B.per_element(ends)
    low = at - np.minimum(place[at], period - 1)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, at + 1, -1)
    return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (left >= width))


def _text_keys(ids: list, ends: np.ndarray, data: np.ndarray, n_buckets: int):
    """The documents' whole texts as sorted keys, with the smallest doc_id of each in the batch."""
    digests, a = [], 0
    for b in ends.tolist():
        digests.append(hashlib.blake2b(data[a:b], digest_size=16).digest())
        a = b
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    keys, bounds, own, _ = B.sorted_keys(both[:, 0].copy(), both[:, 1].copy(), n_buckets)
    owner = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(owner, own, _known(ids))
    return keys, bounds, own, owner


def _copy_states(answers: list | None, ids: list, ends: np.ndarray, data: np.ndarray, n_buckets: int) -> np.ndarray:
    """Of each document: 0 if no other has its text, 1 if it is the first of several, 2 if one before has it."""
    _, bounds, own, _ = _text_keys(ids, ends, data, n_buckets)
    elsewhere = B.read_answers(answers, bounds, bits=False, kind=1)
    first = _first_in_batch(own, np.arange(len(ids)), _known(ids))
    several = (elsewhere > 0) | (np.bincount(own, minlength=int(bounds[-1])) > 1)
    return np.where(~first | (elsewhere == 2)[own], 2, several[own])


def _ask_anchors(stored: DataFrame, elements_of, width: int, least: int) -> tuple[DataFrame, int]:
    period, mask = cover_for(width, least)
    n_buckets = B.bucket_count(stored, mask.mean() * 8 * elements_of.per_byte)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends, data, _ in B.each_batch(rows):
            keys, bounds, _, owner = _text_keys(ids, ends, data, n_buckets)
            yield B.slices(batch, keys, bounds, owner, kind=1)
            elements, ends = elements_of(data, ends)
            at, anchor = _anchors(elements, ends, width, period, mask)
            keys, bounds, _, _ = B.sorted_keys(B.fingerprints(elements, at, anchor), B.fingerprints(
                elements, at, anchor, 1), n_buckets)
            yield B.slices(batch, keys, bounds)

    return B.ask(stored.mapInArrow(send, B.SENT), n_buckets, B.repeated, B.copies), n_buckets


def _ask_windows(stored: DataFrame, replies: DataFrame, elements_of, width: int, least: int,
                 anchor_buckets: int, answer) -> tuple[DataFrame, int]:
    """Windows over repeated anchors ask whether they repeat; a text that a document before has as a whole
    sends none, as the first one sends them. Notes keep the documents' states and the candidates' runs."""
    period, mask = cover_for(width, least)
    n_buckets = B.bucket_count(stored, 2 * elements_of.per_byte)  # 8 to 16 bytes for one element in about six
    with_ids = answer is B.not_first

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends, data, answers in B.each_batch(rows):
            state = _copy_states(answers, ids, ends, data, anchor_buckets)
            elements, ends = elements_of(data, ends)
            at, anchor = _anchors(elements, ends, width, period, mask)
            _, bounds, own, _ = B.sorted_keys(B.fingerprints(elements, at, anchor), B.fingerprints(
                elements, at, anchor, 1), anchor_buckets)
            shared = B.read_answers(answers, bounds) | (np.bincount(own, minlength=int(bounds[-1])) > 1)
            starts = _windows(at[shared[own]], ends, width, period)
            starts = starts[state[np.searchsorted(ends, starts, "right")] < 2]
            jump = np.flatnonzero(np.diff(starts, prepend=-2) > 1)
            runs = np.stack([starts[jump], np.append(starts[jump[1:] - 1], starts[-1:]) + 1]) if len(
                starts) else np.zeros((2, 0))
            keys, bounds, own, _ = B.sorted_keys(B.fingerprints(elements, starts, width), B.fingerprints(
                elements, starts, width, 1), n_buckets)
            owner = None
            if with_ids:  # of each key the smallest doc_id in the batch
                owner = np.full(len(keys), np.iinfo(np.int64).max)
                np.minimum.at(owner, own, _owners(ids, ends, starts))
            yield B.slices(batch, keys, bounds, owner, state.astype(np.int8).tobytes() + runs.astype(np.int64).tobytes())

    sent = B.answered(stored, replies).mapInArrow(send, B.SENT)
    return B.ask(sent, n_buckets, answer), n_buckets


def _known(ids: list) -> np.ndarray:
    """doc_ids as numbers; null counts as smallest."""
    return np.array([np.iinfo(np.int64).min if x is None else x for x in ids], np.int64)


def _owners(ids: list, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """doc_id of the document that each start lies in."""
    return _known(ids)[np.searchsorted(ends, starts, "right")]


def _first_in_batch(own: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows that are the earliest of their key in the batch: smallest doc_id, then place."""
    order = np.lexsort((starts, owner, own))
    new = np.ones(len(own), bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    first = np.zeros(len(own), bool)
    first[order[new]] = True
    return first


def _run_starts(note: bytes) -> np.ndarray:
    lo, hi = np.frombuffer(note, np.int64).reshape(2, -1)
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Words:
    per_byte = 1 / 6

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, stop, word_ends = B.words_of(data, ends)
        return B.word_hashes(data, begin, stop), word_ends


REPORT = "doc_id bigint, n_elements bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"


def removal(docs: DataFrame, elements_of, width: int, least: int, answer, keep_text: bool, name: str,
            join) -> DataFrame:
    """What is left of each document; ``answer`` says which of equal windows go."""
    stored = B.store(docs, name)
    anchor_replies, anchor_buckets = _ask_anchors(stored, elements_of, width, least)
    replies, n_buckets = _ask_windows(stored, anchor_replies, elements_of, width, least, anchor_buckets, answer)
    earlier = answer is B.not_first
    whole_from = 2 if earlier else 1  # the first of equal texts stays where only later windows go

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, ends, data, answers in B.each_batch(rows):
            elements, element_ends = elements_of(data, ends)
            note = B.note_of(answers)
            state = np.frombuffer(note[:len(ids)], np.int8)
            starts = _run_starts(note[len(ids):])
            _, bounds, own, _ = B.sorted_keys(B.fingerprints(elements, starts, width), B.fingerprints(
                elements, starts, width, 1), n_buckets)
            hit = B.read_answers(answers, bounds)
            if earlier:
                hit = hit[own] | ~_first_in_batch(own, starts, _owners(ids, element_ends, starts))
            else:
                hit = (hit | (np.bincount(own, minlength=int(bounds[-1])) > 1))[own]
            gone = B.covered(starts[hit], width, len(elements))
            lens = np.diff(element_ends, prepend=0)
            gone |= np.repeat((state >= whole_from) & (lens >= width), lens)
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_elements", "n_removed", "n_spans", "kept",
                                                    "kept_sha256")}
            a = 0
            kept_all = join(data, ends, gone, element_ends)
            for doc_id, b, kept in zip(ids, element_ends.tolist(), kept_all, strict=True):
                own_gone = gone[a:b]
                out["doc_id"].append(doc_id)
                out["n_elements"].append(b - a)
                out["n_removed"].append(int(own_gone.sum()))
                out["n_spans"].append(int(own_gone[:1].sum() + (own_gone[1:] & ~own_gone[:-1]).sum()))
                out["kept"].append(kept if keep_text else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                a = b
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("doc_id", pa.int64()), ("n_elements", pa.int64()), ("n_removed", pa.int64()),
                 ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())]))

    return B.answered(stored, replies).mapInArrow(remove, REPORT)


def _join_words(data: np.ndarray, ends: np.ndarray, gone: np.ndarray, word_ends: np.ndarray) -> Iterator[bytes]:
    """Kept words of each document, joined by one space."""
    begin, stop, _ = B.words_of(data, ends)
    whole = data.tobytes()
    a = 0
    for b in word_ends.tolist():
        keep = np.flatnonzero(~gone[a:b]) + a
        yield b" ".join([whole[x:y] for x, y in zip(begin[keep].tolist(), stop[keep].tolist(), strict=True)])
        a = b


def remove_repeated_words(docs: DataFrame, width: int = 20, keep_text: bool = True) -> DataFrame:
    """Words covered by a window of ``width`` words that also starts earlier are removed.

    Earlier means a smaller doc_id (null is smallest), or the same document and an earlier
    start; windows are judged on the input. Rows that repeat a doc_id are ordered by where
    they are stored. Null texts have no words; repeated rows count as documents. Returns
    doc_id, n_elements (words), n_removed, n_spans, kept (words joined by one space) and
    its sha256; an empty table gives no rows. Other columns are ignored.
    """
    return removal(docs, Words(), width, min(8, width), B.not_first, keep_text, "words", _join_words)


def keep_texts(report: DataFrame) -> DataFrame:
    """doc_id and what is left of each text, as text (a cut may split a character: it is replaced)."""
    return report.selectExpr("doc_id", "decode(kept, 'UTF-8') AS text")
