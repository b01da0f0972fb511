"""Language of web pages by Bayesian fusion of text, markup, address and host."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewright.llm.shared import bring, hashed_sample, settle
from slatewright.llm.urlfilter import domain_of

#: The most rows with a known language that are used to fit, chosen by a hash of their doc_id.
FIT_ROWS = 8_000
MOST_GRAMS = 4_000
GRAM = 3
#: Texts and declarations are evidence with errors: what a language gets at least from each.
ERROR_MARKUP = 0.05
ERROR_ADDRESS = 0.10
#: No text counts for more than this many n-grams that are independent of each other.
EFFECTIVE_GRAMS = 200
#: Pseudo-pages that a host takes from its domain, a domain from all hosts, and all hosts from equal shares.
HOST_STRENGTH = 5.0
DOMAIN_STRENGTH = 5.0
ALL_STRENGTH = 1.0

#: What address suffixes say by convention.
SUFFIX_LANGUAGES = {
    "at": "de", "de": "de", "es": "es", "fr": "fr", "ie": "en", "mx": "es", "uk": "en", "us": "en",
}

_SPLIT = re.compile(r"[\W\d_]+")
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def grams(text: str) -> Counter:
    """Letter n-grams within words, with a blank at their ends."""
    out: Counter = Counter()
    for word, n in Counter(_SPLIT.split(text.lower())).items():
        if word:
            padded = f" {word} "
            for i in range(len(padded) - GRAM + 1):
                out[padded[i:i + GRAM]] += n
    return out


@dataclass
class TextModel:
    """Log probabilities of n-grams by language."""

    languages: list[str] = field(default_factory=list)
    logs: dict[str, list[float]] = field(default_factory=dict)
    unseen: list[float] = field(default_factory=list)

    def log_likelihoods(self, text: str) -> list[float]:
        found = grams(text)
        total = sum(found.values())
        if not total or not self.languages:
            return [0.0] * len(self.languages)
        sums = [0.0] * len(self.languages)
        for gram, n in found.items():
            for k, v in enumerate(self.logs.get(gram, self.unseen)):
                sums[k] += n * v
        scale = min(1.0, EFFECTIVE_GRAMS / total)
        top = max(sums)
        return [(s - top) * scale for s in sums]


def fit(docs: DataFrame, most_rows: int = FIT_ROWS, most_grams: int = MOST_GRAMS) -> TextModel:
    """Counts n-grams by language over at most ``most_rows`` documents; counts are summed in each partition, and
    ``most_grams`` of each language reach the driver. Null languages, texts and ids are left out."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # ids are chosen first: texts are not brought together
    chosen = hashed_sample(usable.select("doc_id"), "doc_id", most_rows).distinct()
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(grams(text))
        for lang, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts)),
                                              pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = (rows.select("lang", "text").mapInArrow(count, "lang string, gram string, n bigint")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("_rank", F.row_number().over(top)).where(F.col("_rank") <= most_grams).drop("_rank").collect()
    by_lang: dict[str, dict[str, int]] = {}
    for r in kept:
        by_lang.setdefault(r.lang, {})[r.gram] = r.n
    languages = sorted(by_lang)
    vocabulary = sorted({g for c in by_lang.values() for g in c})
    totals = [sum(by_lang[x].values()) + 0.5 * (len(vocabulary) + 1) for x in languages]
    logs = {g: [math.log((by_lang[x].get(g, 0) + 0.5) / t) for x, t in zip(languages, totals, strict=True)] for g in vocabulary}
    return TextModel(languages, logs, [math.log(0.5 / t) for t in totals])


def visible(html: str) -> str:
    """The text between the marks of a page."""
    from html import unescape

    return unescape(_MARKUP.sub(" ", html))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, declared (language of the markup), suffix (language that the host's last label or a
    first folder names) and text: log likelihoods of the visible text, one a language."""
    tag = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    host = host_of(F.col("url"))
    folder = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    table = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGES.items() for x in pair])
    by_suffix = F.coalesce(F.when(folder != "", folder), F.try_element_at(table, F.regexp_extract(host, r"\.([a-z]+)$", 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.names.index("html")).to_pylist()
            scores = pa.array([model.log_likelihoods(visible(x or "")) for x in html], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "text"])

    rows = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(domain_of(host), F.lit("")).alias("domain"),
                        F.coalesce(tag, F.lit("")).alias("declared"), F.coalesce(by_suffix, F.lit("")).alias("suffix"), "html")
    return rows.mapInArrow(run, "page_id bigint, host string, domain string, declared string, suffix string, "
                                "text array<double>")


def _softmax(logs: Column) -> Column:
    weights = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, lang and posterior: the most probable language given all evidence.

    First each page is judged by itself: text likelihood, markup and address suffix, each
    with an error rate. The pages' shares are summed by host, domain and overall (summed
    in each task first, and brought back to the pages in as many tasks as it takes, so a host with a third of all
    pages is no hot key), and smoothed
    down the hierarchy: a host's prior leans on its domain's, and that on all pages'. A
    page's own shares are taken out of the sums before they judge it. Pages without host,
    text or known declarations get what is left; null html is empty; repeated rows count
    as pages; an empty table gives no rows, a model without languages null.
    """
    langs = model.languages
    if not langs:
        return pages.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
                            F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    known = F.array(*[F.lit(x) for x in langs])

    def said(column: str, error: float) -> Column:
        right, wrong = math.log(1 - error), math.log(error / max(1, len(langs) - 1))
        hit = F.array_contains(known, F.col(column))
        return F.transform(known, lambda x: F.when(~hit, F.lit(0.0)).when(x == F.col(column), F.lit(right)).otherwise(F.lit(wrong)))

    add = lambda a, b: a + b
    own = F.zip_with(F.zip_with("text", said("declared", ERROR_MARKUP), add), said("suffix", ERROR_ADDRESS), add)
    judged = settle(evidence(pages, model).withColumn("logs", own).withColumn("shares", _softmax(F.col("logs")))
                    .drop("text"), "page-evidence")
    k = range(len(langs))
    sums = [F.sum(F.get("shares", i)).alias(f"_s{i}") for i in k]
    totals = [F.sum(f"_s{i}").alias(f"_s{i}") for i in k]
    hosts = settle(judged.groupBy("domain", "host").agg(F.count(F.lit(1)).alias("pages"), *sums), "host-shares")
    domains = hosts.groupBy("domain").agg(F.count(F.lit(1)).alias("hosts"), *totals)
    everything = hosts.agg(*totals).first()
    overall = [ALL_STRENGTH / len(langs) + (everything[f"_s{i}"] or 0.0) for i in k]
    overall = [x / sum(overall) for x in overall]

    listed = lambda df, name: df.select(*[c for c in df.columns if not c.startswith("_s")],
                                        F.array(*[f"_s{i}" for i in k]).alias(name))
    priors = bring(listed(hosts, "_host"), ["domain"], listed(domains, "_domain"), "hosts", ["_domain"])
    joined = bring(judged, ["domain", "host"], priors, "pages", ["_host", "_domain"])
    minus = lambda a, b: F.greatest(F.lit(0.0), a - b)
    total = lambda c: F.aggregate(c, F.lit(0.0), add)
    base = F.array(*[F.lit(x) for x in overall])
    joined = (joined.withColumn("_d", F.zip_with("_domain", "shares", minus)).withColumn("_h", F.zip_with("_host", "shares", minus))
              .withColumn("_dp", F.zip_with("_d", base, lambda s, p: (s + DOMAIN_STRENGTH * p) / (total(F.col("_d")) + DOMAIN_STRENGTH)))
              .withColumn("_hp", F.zip_with("_h", "_dp", lambda s, p: (s + HOST_STRENGTH * p) / (total(F.col("_h")) + HOST_STRENGTH)))
              .withColumn("_post", _softmax(F.zip_with("logs", "_hp", lambda v, p: v + F.log(F.greatest(p, F.lit(1e-12)))))))
    best = F.array_max("_post")
    return joined.select("page_id", "host", F.get(known, F.array_position("_post", best).cast("int") - 1).alias("lang"),
                         F.round(best, 9).alias("posterior"))
