"""Spelling variants against a version that compares all words with all."""

from __future__ import annotations

import random
import zlib
from collections import Counter

from slatewright.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(counts: dict[str, int]) -> set[tuple]:
    known = {}
    for word, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(word, v))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        known[word] = (form, n, len(near), counts[form] if form is not None else None)
    out = set()
    for word, (form, n, n_near, form_n) in known.items():
        root = word
        while known[root][0] is not None:
            root = known[root][0]
        out.add((word, form, root, n, n_near, form_n))
    return out


def found(spark, counts: dict[str, int], **extra) -> set[tuple]:
    df = spark.createDataFrame(list(counts.items()) or [], "word string, n bigint")
    rows = spelling.variants(df).collect()
    assert len(rows) == len(counts)
    return set(map(tuple, rows))


def test_random_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SEGMENT_POINTS", 60)  # words share nodes over many segments
    rng = random.Random(5)
    counts = {}
    for _ in range(700):
        word = "".join(rng.choice("aabé") for _ in range(rng.randint(0, 7)))
        counts[word] = int(10 ** rng.uniform(0, 5))
    assert found(spark, counts) == plain(counts)


def test_chains_ties_and_long_words(spark):
    long = "ab" * 20_000
    counts = {"colours": 1000, "colors": 90, "colour": 9, "xolours": 1000, "colourss": 100, "colourz": 100, long: 1, long + "b": 50,
              "b" + long: 50, "aaaaaaa": 3, "aaaaaaaa": 30, "aaaaaaaaa": 300, "zß\U0001f600yyyyy": 2, "z\U0001f600yyyyy": 20, "": 4, "q": 40}
    assert found(spark, counts) == plain(counts)


def test_no_words(spark):
    assert found(spark, {}) == set()


def test_counts(spark):
    rows = [(1, "Colours colours COLOURS, tiny Ünlaute été×÷ÿéé"), (2, None), (3, ""), (None, "colours"), (1, "colours"), (4, "Colours " * 400)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, n bigint")
    want: Counter = Counter()
    for doc_id, text in rows:
        for run in spelling.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.word_counts(docs.repartition(3)).collect()} == want


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    frequent = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:1200])
    assert found(spark, frequent) == plain(frequent)
