"""Token files: exact round trips."""

import zlib

import numpy as np
import pytest

from slatewright.llm import rangecoder, tokenfiles
from slatewright.llm.shared import shared_path

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n,block,lanes", [(0, 64, 8), (1, 64, 8), (64, 64, 8), (65, 64, 8), (5000, 64, 8), (3000, 2048, 4096)])
def test_coder_round_trip(n, block, lanes):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.zipf(1.3, n) % 50257, np.full(n, 65535)):
        frame = rangecoder.encode(ids, block, lanes)
        assert (rangecoder.decode(frame, lanes) == ids).all()


def test_repetition_is_cheap_and_damage_is_found():
    ids = np.tile(np.arange(50), 200)
    frame = bytearray(rangecoder.encode(ids))
    assert len(frame) < len(ids)
    frame[-20] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode(bytes(frame))


def test_blocks_are_smaller_than_zlib_and_decode_alone():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 50257, rng.integers(1, 4)) for _ in range(3000)]
    ids = np.concatenate([words[int(k) % 3000] for k in rng.zipf(1.3, 20000)]).astype(np.uint32)
    whole = len(rangecoder.encode(ids))
    plain = sum(len(zlib.compress(ids[i:i + rangecoder.BLOCK].astype("<u2").tobytes(), 9)) for i in range(0, len(ids), rangecoder.BLOCK))
    assert whole < plain
    for first in (0, 3 * rangecoder.BLOCK):
        part = ids[first:first + rangecoder.BLOCK]
        alone = rangecoder.encode(part)
        assert (rangecoder.decode(alone) == part).all()
        assert alone[rangecoder.HEAD.size:] in rangecoder.encode(ids)


def test_carries_and_rare_bits():
    """Each id comes when its bits are least likely, so ranges are narrow and carries run far."""
    ids = np.concatenate([np.tile([a, a ^ 65535], 40) for a in range(0, 65536, 997)] + [np.arange(65536)[::-1]])
    for block in (16, 2048):
        assert (rangecoder.decode(rangecoder.encode(ids, block)) == ids).all()


def test_large_ids_are_refused():
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([65536]))


def test_pieces_equal_whole_texts():
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = tokenfiles.PieceEncoder(f.read())
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "'", "12", "é", "²", ".", "!", "\x1c", "\xa0", "中", "<|endoftext|>", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert encoder(text) == encoder.whole(text), repr(text)


def test_texts_encoded_together_equal_whole_texts_in_few_calls(monkeypatch):
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = tokenfiles.PieceEncoder(f.read())
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) + rng.choice(["", "", ",", ".", "'s", "-1"])
                      for _ in range(60)) for _ in range(50)]
    calls = []
    whole = tokenfiles.PieceEncoder.whole
    monkeypatch.setattr(tokenfiles.PieceEncoder, "whole", lambda self, text: calls.append(text) or whole(self, text))
    got = encoder.many(texts)
    assert len(calls) < 2 * len(texts)  # heads, and what follows words; not each of some 2 900 words
    odd = ["", " ", "a  b", "x <|endoftext|> y", "中 文 é\x1c ok", "a\n b", "one\ttwo", "a \xa0 b", "\u0120x y \u0120", "Ω2 x"]
    monkeypatch.setattr(tokenfiles, "_CACHED_PIECES", 10)
    assert got + encoder.many(odd) + encoder.many(odd[::-1]) == [whole(encoder, t) for t in texts + odd + odd[::-1]]


def test_coder_settles_ranges_three_times_an_id(monkeypatch):
    calls = []
    settle = rangecoder._Out.settle
    monkeypatch.setattr(rangecoder._Out, "settle", lambda self, *a: calls.append(1) or settle(self, *a))
    ids = np.random.default_rng(4).integers(0, 65536, 500)
    frame = rangecoder.encode(ids)
    assert len(calls) <= 3 * len(ids)
    assert (rangecoder.decode(frame) == ids).all()


def test_nodes_keep_their_least_shares():
    """However often a node is passed, its children stay in order and none gets less than the coder's rounding needs."""
    rng = np.random.default_rng(5)
    nodes = rangecoder._START.copy()
    assert nodes.shape == (rangecoder._NODES, 16)
    for k in range(3000):
        at = np.arange(len(nodes))
        child = rng.integers(0, 16, len(nodes)) if k % 3 else np.full(len(nodes), k // 300)
        rangecoder._pass(nodes, at, nodes[at], child)
    begins = np.concatenate([np.zeros((len(nodes), 1), int), nodes[:, 1:], np.full((len(nodes), 1), rangecoder._WHOLE)], axis=1)
    assert np.diff(begins, axis=1).min() >= rangecoder._LEAST
    assert (nodes[:, 0] == rangecoder._MOST).all()


def test_files(spark):
    rows = [(3, "one two"), (None, "null id"), (1, None), (2, ""), (4, "x y"), (4, "x y"), (5, "word " * 3000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start string").repartition(3)
    path = shared_path(spark, "test-ids")
    tokenfiles.write_ids(docs, path, TOKENIZER)
    got = tokenfiles.digest(tokenfiles.read_ids(spark, path)).collect()
    with open(TOKENIZER, encoding="utf-8") as f:
        encoder = tokenfiles.PieceEncoder(f.read())
    start = 0
    assert len(got) == len(rows)
    for row, (doc_id, text) in zip(sorted(got, key=lambda r: r.start), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_table(spark):
    path = shared_path(spark, "test-ids-empty")
    tokenfiles.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, TOKENIZER)
    assert tokenfiles.read_ids(spark, path).count() == 0
