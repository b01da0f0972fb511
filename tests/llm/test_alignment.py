"""Cross-tokenizer alignment against a plain version that walks token by token."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from slatewright.llm import alignment  # noqa: E402

TEXTS = [
    "The quick brown fox, jumping over it.", "The quick brown fox, jumping over it.", None, "", " ", "a  b   c ", "\n\n x \n y\tz",
    "naïve café — “quoted” ﬁgure", "日本語 テキスト and 한국어", "emoji 😀😀 x", "<|endoftext|> and </s> <s> <unk> <0x41>",
    "piece ▁ mark", "word" * 3000, "one two   three\u0085four", "line one\n line two\n", "x" * 5000 + " the end",
    "tab\t \ttab", "'tis we'll they've I'd", "a" * 1 + " " + "b c " * 900 + "d",
]


@pytest.fixture(scope="module")
def definitions():
    return alignment.Definitions.read(*(str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def plain(rows: list[tuple], definitions) -> list[tuple]:
    """Whole texts through both libraries, links by comparing all byte ranges in order."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_str(definitions.a_json)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_proto=definitions.b_model)
    alphabet = alignment.byte_alphabet()
    found, counts = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            whole = (" " + text).encode()
            ids_a = a_side.encode(" " + text, add_special_tokens=False).ids
            ids_b = b_side.encode(text)
            bytes_a = [bytes(alphabet[c] for c in a_side.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else
                       b_side.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == whole == b"".join(bytes_b):
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                begins_a, begins_b = [0, *ends_a], [0, *ends_b]
                first = 0
                for i, end in enumerate(ends_a):
                    while ends_b[first] <= begins_a[i]:
                        first += 1
                    j = first
                    while j < len(ids_b) and begins_b[j] < end:
                        links.append((ids_a[i], ids_b[j]))
                        j += 1
                marks = sorted(set(ends_a) & set(ends_b))
                last_a = last_b = 0
                for m in marks:
                    k, n = ends_a.index(m, last_a) + 1, ends_b.index(m, last_b) + 1
                    groups.append(",".join(map(str, ids_a[last_a:k])) + "|" + ",".join(map(str, ids_b[last_b:n])))
                    last_a, last_b = k, n
                found.append((doc_id, len(ids_a), len(ids_b), groups, links))
                counts.update(set(links))
                continue
        found.append((doc_id, 0, 0, [], []))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(d, n_a, n_b, len(g), len(li), sum(counts[x] == best[x[0]] for x in li), sum(counts[x] for x in li),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n_a, n_b, g, li in found]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_is_the_plain_one(spark, definitions, broadcast_pairs):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_a int")
    got = alignment.corpus_digest(docs.repartition(3), definitions, broadcast_pairs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, definitions)))


def test_given_documents(spark, definitions):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = alignment.corpus_digest(docs, definitions).collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()], definitions)
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark, definitions):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.corpus_digest(docs, definitions).collect() == []


def test_list_of_merges_and_ranks_agree(definitions):
    aligner = alignment.Aligner(definitions)
    slow = alignment.Aligner(alignment.Definitions(definitions.a_json, definitions.b_model, False))
    assert aligner.words.ranked is not None and slow.words.ranked is None
    fast_out, slow_out = aligner(TEXTS), slow(TEXTS)
    assert all(np.array_equal(fast_out[k], slow_out[k]) for k in fast_out)


def test_lanes_do_not_change_links():
    rng = np.random.default_rng(7)
    ends_a, ends_b = (np.unique(np.append(rng.integers(1, 9000, 2500), 9000)) for _ in range(2))
    one = alignment.merge_lockstep(ends_a, ends_b, np.array([0, 9000]))
    many = alignment.merge_lockstep(ends_a, ends_b, np.unique(np.concatenate([[0, 9000], rng.choice(ends_a, 40), rng.choice(ends_b, 40)])))
    assert all(np.array_equal(x, y) for x, y in zip(one, many, strict=True))
