"""Toxicity: a lexicon learned from labels, matched through spelling errors, judged in context.

A term of the lexicon is a word, or a stem that begins words; the words a stem was learned
from stand beside it, so that their misspellings are found too. The lexicon is kept as a
trie. A word of a text runs through it together with the Levenshtein automaton of the
word: the states reached are the trie nodes whose prefix lies within the allowed number
of edits, so misspelled terms are found without comparing the word with every term. Each
hit is judged by the words around it: quotation marks and words of report count as
quotation, other hits as abuse. A small logistic regression over the hits of a text gives
the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.llm.shared import hashed_sample

#: The most labelled rows that are used to fit, chosen by a hash of their doc_id.
FIT_ROWS = 20_000
#: The most terms of a lexicon. Greedy choice ends long before: at 33 terms on the given table of 10 000 documents.
MOST_TERMS = 512
WINDOW = 5
STEM_LENGTHS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
_CACHED_WORDS = 300_000
_COUNTED_TERMS = 500_000

#: Signs and words of quotation or report.
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset({
    "said", "says", "wrote", "called", "quoted", "quote", "word", "term", "sagte", "schrieb", "nannte",
    "zitat", "wort", "dit", "appelé", "citation", "mot", "dijo", "llamó", "cita", "palabra",
})

_STRIP = re.compile(r"^[\W_]+|[\W_]+$")


#: Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")


def plain(token: str) -> str:
    """A token between white space in lower case, without signs around it."""
    return _STRIP.sub("", token).lower()


def respelled(token: str) -> str:
    """The token with the letters that digits and signs within it may stand for."""
    return plain(token.strip(".,;:?\"'()").translate(LOOKALIKES))


def allowed_edits(term: str, stem: bool) -> int:
    """Short terms must be spelled as they are; longer ones may miss by one edit, words of 10 letters by two.

    A stem says nothing about the end of a word, so it takes 7 letters until an edit is allowed."""
    return int(len(term) >= 7) if stem else int(len(term) >= 5) + int(len(term) >= 10)


def _pieces(term: str, edits: int) -> list[tuple[int, str]]:
    """(start, letters) of parts with a letter between them, one more than edits: some part is as it was, the first
    one at its place, the last one at its distance from the end, others shifted by ``edits`` at most."""
    size = (len(term) - edits) // (edits + 1)
    starts = [i * (size + 1) for i in range(edits)] + [len(term) - size]
    return [(a, term[a:a + size]) for a in starts]


class Trie:
    """The lexicon as nested nodes, walked in step with a word's Levenshtein automaton."""

    def __init__(self, terms: dict[tuple[str, bool], float]) -> None:
        self.root: dict = {}
        #: What parts of words can hold a term with edits: by length of the word for words, for stems by none.
        self.pieces: dict[int, dict[tuple[int, int], set[str]]] = {}
        self.beginnings: dict[tuple[int, int], set[str]] = {}
        for (term, stem), weight in terms.items():
            node, most = self.root, allowed_edits(term, stem)
            for c in term:
                node["most"] = max(most, node.get("most", 0))
                node = node.setdefault(c, {})
            node["most"] = max(most, node.get("most", 0))
            node.setdefault("", []).append((stem, most, weight))
            for start, letters in _pieces(term, most) if most else ():
                for shift in range(-most, most + 1) if start else (0,):
                    at = (start + shift, start + shift + len(letters))
                    if stem:
                        self.beginnings.setdefault(at, set()).add(letters)
                    elif start + len(letters) < len(term):
                        for size in range(len(term) - most, len(term) + most + 1):
                            self.pieces.setdefault(size, {}).setdefault(at, set()).add(letters)
                    else:
                        self.pieces.setdefault(len(term) + shift, {}).setdefault(at, set()).add(letters)

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and edits of the best matching term: fewest edits, then greatest weight."""
        best, node = None, self.root
        for c in word:  # no edits: stems on the path, and words at its end
            node = node.get(c)
            if node is None:
                break
            best = max((w for stem, _, w in node.get("", ()) if stem), default=best) if best is None else best
        else:
            best = max([w for stem, _, w in node.get("", ()) if not stem] + [best or 0.0]) or None
        if best is not None:
            return best, 0
        if (any(word[a:b] in known for (a, b), known in self.pieces.get(len(word), {}).items())
                or any(word[a:b] in known for (a, b), known in self.beginnings.items())):
            near = self._near(word)
            return None if near is None else (-near[1], near[0])
        return None

    def _near(self, word: str) -> tuple[int, float] | None:
        n, best = len(word), None
        # state of the automaton: least edits by the number of read letters of the word, alive ones only
        stack = [(self.root, {i: i for i in range(min(n, self.root.get("most", 0)) + 1)}, {}, "")]
        while stack:
            node, state, before, last = stack.pop()
            for stem, edits, weight in node.get("", ()):
                # a stem is left wherever the word goes on
                cost = min(state.values()) if stem else state.get(n, edits + 1)
                if cost <= edits and (best is None or (cost, -weight) < best):
                    best = (cost, -weight)
            for c, child in node.items():
                if len(c) != 1:
                    continue
                step: dict[int, int] = {}
                most = child["most"]
                for i, cost in state.items():
                    if i < n and word[i] == c and cost < step.get(i + 1, most + 1):
                        step[i + 1] = cost
                    if cost < most:
                        step[i] = min(step.get(i, most + 1), cost + 1)
                        if i < n:
                            step[i + 1] = min(step.get(i + 1, most + 1), cost + 1)
                for i, cost in before.items():  # two neighbours in each other's place are one edit
                    if i + 1 < n and cost < most and word[i] == c and word[i + 1] == last:
                        step[i + 2] = min(step.get(i + 2, most + 1), cost + 1)
                for i in sorted(step):
                    if step[i] < most and i < n:
                        step[i + 1] = min(step.get(i + 1, most + 1), step[i] + 1)
                if step:
                    stack.append((child, step, state, c))
        return best


#: What a text's hits are counted as.
FEATURES = ("abuse", "abuse_near", "quoted", "share")


@dataclass
class ToxicityModel:
    terms: dict[tuple[str, bool], float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-4.0, 3.0, 2.5, 0.3, 0.5])


class Scorer:
    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.trie = model, Trie(model.terms)
        scorer = self

        class Matches(dict):
            def __missing__(self, token: str):
                if len(self) >= _CACHED_WORDS:
                    self.clear()
                found = scorer.trie.match(plain(token))
                if found is None and not token.isalpha():
                    found = scorer.trie.match(respelled(token))
                self[token] = found
                return found

        self.matches = Matches()

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        found = list(map(self.matches.__getitem__, tokens))
        if not any(found):
            return [0.0] * len(FEATURES)
        abuse = near = quoted = 0.0
        hits = [i for i, x in enumerate(found) if x]
        for i in hits:
            weight, edits = found[i]
            strength = min(1.0, weight / 4)
            if self.is_quoted(tokens, i):
                quoted += strength
            elif edits:
                near += strength / edits
            else:
                abuse += strength
        return [math.log1p(abuse), math.log1p(near), math.log1p(quoted), math.sqrt(len(hits) / len(tokens))]

    @staticmethod
    def is_quoted(tokens: list[str], i: int) -> bool:
        """Is the word within quotation marks, or near a word of report that is followed by marks?"""
        left, right = tokens[max(0, i - WINDOW):i + 1], tokens[i:i + WINDOW + 1]
        opened = any(t[:1] in QUOTES and t[:1] for t in left) and not any(t[-1:] in QUOTES for t in left[:-1])
        closed = any(t.rstrip(".,;:!?")[-1:] in QUOTES and t.rstrip(".,;:!?") for t in right)
        reported = any(plain(t) in REPORTING for t in left[:-1])
        return opened and closed or reported and (opened or closed)

    def score(self, text: str) -> float:
        return logistic([1.0, *self.features(text)], self.model.weights)


def logistic(x: list[float], weights: list[float]) -> float:
    z = sum(a * b for a, b in zip(x, weights, strict=True))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id):
    """A row without id is in neither part: it fits nothing, and counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """At most ``most`` labelled documents that are not held out: doc_id, text, toxic. A doc_id with labels
    of both kinds is left out, and so are null ids and labels."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
             .where("toxic = _most").select("doc_id", "toxic"))
    chosen = hashed_sample(known, "doc_id", most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = FIT_ROWS, most_terms: int = MOST_TERMS) -> ToxicityModel:
    """Learns lexicon and weights from ``labels.toxic`` of a bounded number of rows; without toxic ones the lexicon
    is empty.

    Document counts of words and word beginnings, in toxic texts and in others, are summed
    and compared by Spark. Candidates occur in toxic texts and hardly elsewhere. The lexicon
    is built greedily: the candidate that explains most toxic texts not explained so far
    goes in, so that copies of one text don't fill it. Beside a chosen stem go the words of
    toxic texts that it begins, however rare. What reaches the driver is bounded by
    ``most_rows``.
    """
    rows = fit_rows(docs, labels, most_rows).cache()
    try:
        return _fit(rows, most_terms)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, most_terms: int) -> ToxicityModel:
    counts = {r.toxic: r.n for r in rows.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic:
        return ToxicityModel()

    least = max(4, round(0.004 * n_toxic))
    counted = _term_counts(rows)
    clear = {(r.term, r.stem): (r.n_in, r.n_out) for r in counted.where(f"n_in >= {least} AND {_PURE}").collect()}
    holders: dict[tuple[str, bool], set[int]] = {t: set() for t in clear}
    for r in _term_documents(rows.where("toxic <> 0"), set(clear)).collect():
        holders[r.term, r.stem].update(r.docs)
    terms = _cover({t: (d, *clear[t]) for t, d in holders.items()}, n_toxic, n_other, least, most_terms)
    model = ToxicityModel({**_stem_words(rows, terms), **terms})
    scored = features(rows.select("doc_id", "text", "toxic"), model, "toxic").groupBy("features", "toxic").count().collect()
    x = np.array([[1.0, *r.features] for r in scored]).reshape(-1, 1 + len(FEATURES))
    y = np.array([float(bool(r.toxic)) for r in scored])
    model.weights = _regress(x, y, np.array([r["count"] for r in scored], float), np.array(model.weights))
    return model


def _terms(text: str | None) -> set[tuple[str, bool]]:
    found = {plain(t) for t in set((text or "").split())}
    return {(w, False) for w in found if len(w) >= 3} | {(w[:k], True) for w in found for k in STEM_LENGTHS if len(w) > k}


#: Labels have errors.
_PURE = "n_in >= 0.95 * (n_in + n_out)"


def _term_counts(rows: DataFrame, stems: set[str] | None = None) -> DataFrame:
    """term, stem, n_in, n_out: in how many toxic and other texts; summed in each partition before the shuffle.

    With ``stems`` only the words that begin with one of them."""
    lengths = sorted({len(t) for t in stems or ()})

    def of(text: str | None) -> set[tuple[str, bool]]:
        if stems is None:
            return _terms(text)
        return {(w, False) for w in {plain(t) for t in set((text or "").split())}
                if any(len(w) > k and w[:k] in stems for k in lengths)}

    def listed(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.bool_()),
             pa.array([a for a, _ in found.values()], pa.int64()), pa.array([b for _, b in found.values()], pa.int64())],
            names=["term", "stem", "n_in", "n_out"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for term in of(text):
                    a, b = found.get(term, (0, 0))
                    found[term] = (a + 1, b) if toxic else (a, b + 1)
                if len(found) >= _COUNTED_TERMS:
                    yield listed(found)
                    found = {}
        yield listed(found)

    return (rows.select("text", F.col("toxic") != 0)
            .mapInArrow(count, "term string, stem boolean, n_in bigint, n_out bigint")
            .groupBy("term", "stem").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")))


def _stem_words(rows: DataFrame, terms: dict[tuple[str, bool], float]) -> dict[tuple[str, bool], float]:
    """The words of toxic texts, and hardly of others, that a chosen stem begins, with the weight of the longest one."""
    stems = {t: w for (t, stem), w in terms.items() if stem}
    if not stems:
        return {}
    found = _term_counts(rows, set(stems)).where(f"n_in > 0 AND {_PURE}").select("term").collect()
    return {(r.term, False): stems[max((r.term[:k] for k in range(1, len(r.term)) if r.term[:k] in stems), key=len)]
            for r in found}


def _term_documents(rows: DataFrame, only: set) -> DataFrame:
    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for term in _terms(text) & only:
                    found.setdefault(term, []).append(doc_id)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.bool_()),
             pa.array(list(found.values()), pa.list_(pa.int64()))], names=["term", "stem", "docs"])

    return rows.select("doc_id", "text").mapInArrow(hold, "term string, stem boolean, docs array<bigint>")


def _cover(candidates: dict, n_toxic: int, n_other: int, least: int, most: int) -> dict[tuple[str, bool], float]:
    """Terms that explain at least ``least`` toxic texts not explained so far, greedily; then terms that no clean
    text and one in thirty of the toxic ones hold, unless they follow from the chosen ones."""
    terms: dict[tuple[str, bool], float] = {}

    def choose(key: tuple[str, bool]) -> None:
        _, n_in, n_out = candidates[key]
        terms[key] = math.log((n_in + 0.5) / (n_toxic + 1)) - math.log((n_out + 0.5) / (n_other + 1))

    rest = {k: set(d) for k, (d, _, _) in candidates.items()}
    while rest and len(terms) < most:
        # whole words go before the stems they begin with, at equal use
        key = max(rest, key=lambda k: (len(rest[k]), not k[1], len(k[0]), k[0]))
        own = rest.pop(key)
        if len(own) < least:
            break
        choose(key)
        rest = {k: d - own for k, d in rest.items() if len(d - own) >= least}
    for key in sorted(candidates, key=lambda k: (-candidates[k][1], k[1], -len(k[0]), k[0])):
        _, n_in, n_out = candidates[key]
        if len(terms) >= most or 30 * n_in < n_toxic:
            break
        follows = any((stem and key[0].startswith(t)) or (key[1] and t.startswith(key[0])
                                                          and candidates[t, stem][1] >= 0.9 * n_in) for t, stem in terms)
        if not n_out and not follows and key not in terms:
            choose(key)
    return terms


def _regress(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, spread: float = 2.0) -> list[float]:
    """Logistic regression by Newton's method; weights are drawn to ``prior`` and don't turn against it."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - (w - prior) / spread**2
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    w[1:3] = np.maximum(w[1:3], prior[1:3])
    return [float(v) for v in w]


def features(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    kinds = {"toxic": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            names = batch.schema.names
            text = batch.column(names.index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(k)) for k in keep),
                 pa.array([[round(v, 6) for v in scorer.features(t or "")] for t in text], pa.list_(pa.float64()))],
                names=[*keep, "features"])

    kept = "".join(f"{k} {kinds.get(k, 'bigint')}, " for k in keep)
    return docs.mapInArrow(run, f"{kept}features array<double>")


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` with toxicity (0 to 1), over whole texts; the model, of bounded size, goes with the job.

    Null and empty texts have no hits and score as such; repeated rows score alike; an
    empty table stays empty. A column named toxicity is replaced.
    """
    names = [c for c in docs.columns if c != "toxicity"]
    schema = docs.select(*names).schema.add("toxicity", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            text = batch.column(batch.schema.names.index("text")).to_pylist()
            scores = pa.array([scorer.score(t or "") for t in text], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, "toxicity"])

    return docs.select(*names).mapInArrow(run, schema)
