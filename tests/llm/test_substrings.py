"""Substring deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from slatewright.llm import batches, substrings, suffixes


@pytest.mark.parametrize("width,least", [(20, 8), (400, 64), (9, 9), (10, 3), (1, 1)])
def test_covers_align_all_residues(width, least):
    period, mask = substrings.cover_for(width, least)
    chosen = np.flatnonzero(mask)
    assert width - period + 1 >= least
    assert {(a - b) % period for a in chosen for b in chosen} == set(range(period))


def sample(seed: int, n: int = 60):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "the", "of", "x1", "zz", "é", "ü", "long" * 20]
    bases = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(3)]
    rows = []
    for i in range(n):
        kind, words = rng.random(), list(rng.choice(bases))
        if kind < 0.3:
            text = " ".join(words)
        elif kind < 0.7:
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(200)] = rng.choice(vocabulary)
            text = " ".join(words)
        elif kind < 0.9:
            p = rng.randrange(150)
            noise = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
            text = noise() + "\n\t " + " ".join(words[p:p + rng.randint(15, 45)]) + "  " + noise()
        else:
            text = rng.choice(["", None, "one", "the of"])
        rows.append((None if i == 7 else i, text))
    rng.shuffle(rows)
    return rows


def brute_words(rows, width=20):
    listed = [(i, re.findall("[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in listed:
        for p in range(len(words) - width + 1):
            key, at = tuple(words[p:p + width]), (-1 if i is None else i, p)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, words in listed:
        gone = [False] * len(words)
        for p in range(len(words) - width + 1):
            if first[tuple(words[p:p + width])] < (-1 if i is None else i, p):
                gone[p:p + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows, width=400):
    listed = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[p:p + width] for _, b in listed for p in range(len(b) - width + 1))
    out = []
    for i, b in listed:
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if counts[b[p:p + width]] > 1:
                gone[p:p + width] = [True] * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = sample(seed)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, batch int").repartition(5)
    got = substrings.remove_repeated_words(docs).select("doc_id", "n_elements", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute_words(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = sample(seed)
    rows.append(rows[0])  # a repeated row is a second copy
    docs = spark.createDataFrame([(*r, "") for r in rows], "doc_id long, text string, keys string").repartition(5)
    got = suffixes.remove_repeated_bytes(docs).select("doc_id", "n_elements", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute_bytes(rows))


def test_overlaps_within_one_document(spark):
    rows = [(1, "ab" * 700), (2, "x" * 399), (3, "x" * 400), (4, "w " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeated_bytes(docs).select("doc_id", "n_elements", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_bytes(rows))
    got = substrings.remove_repeated_words(docs).select("doc_id", "n_elements", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(rows))


def test_repeated_doc_id_keeps_one_copy(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (1, text)], "doc_id long, text string")
    removed = sorted(r.n_removed for r in substrings.remove_repeated_words(docs).collect())
    assert removed == [0, 50, 50]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeated_words(empty).count() == 0
    assert suffixes.remove_repeated_bytes(empty).count() == 0


def test_words_longer_than_a_chunk_and_small_batches(spark, monkeypatch):
    long_word = "y" * (batches.CHUNK + 10)
    rows = [(k, " ".join([long_word, *(f"w{i}" for i in range(25)), str(k)])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = substrings.remove_repeated_words(docs).select("doc_id", "n_elements", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_words(rows))
