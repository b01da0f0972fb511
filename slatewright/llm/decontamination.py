"""Benchmark decontamination with a broadcast set of normalised n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewright.llm.shared import settle

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The benchmark's windows are broadcast up to this many bytes of words and items; beyond, they are shuffled.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case; none for null."""
    # lower() is the same for texts of ASCII only, and several times faster
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower()))
    cut = F.split(F.regexp_replace(plain, "^" + _SEPARATORS, ""), _SEPARATORS, -1)
    # only the last part can be empty: leading separators are gone and others are merged
    kept = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return F.coalesce(kept, F.array().cast("array<string>"))


def windows(listed: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words, in order."""
    last = F.size(listed) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last),
                                         lambda i: F.xxhash64(*[F.get(listed, i + k) for k in range(size)]))
                  ).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(length, words, items): distinct windows of the items; a shorter item is one window. Windows of items without id
    are windows like others and add none to ``items``."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    found = items.select("item_id", length.alias("length"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice(F.col("w"), i, length))).alias("words"))
    return found.groupBy("length", "words").agg(F.collect_set("item_id").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Which words of each document lie in a window that a benchmark item holds.

    All windows of a document are hashed and meet the benchmark's hashes; the windows of
    the documents with hits are then compared word by word. Returns doc_id, text_hash,
    n_words, hits (array of (pos, length): first word from 0 and length of every verified
    window), items (their item_ids), n_hit (words inside any of them), one row for each
    row of ``docs``. A null text has no words; items without words are left out, items without
    id hit words and are not listed; an empty benchmark hits nothing; rows that repeat whole get equal results. Other columns
    are ignored.
    """
    known = settle(benchmark_windows(benchmark, size), "benchmark-windows")
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # size values at most
    size_of = lambda column: F.aggregate(column, F.lit(24).cast("long"), lambda n, x: n + 24 + F.octet_length(x))
    held = known.agg(F.sum(size_of(F.col("words")) + size_of(F.transform("items", lambda x: x.cast("string"))))).first()[0] or 0
    few = held <= BROADCAST_BYTES
    hinted = F.broadcast if few else (lambda df: df)

    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    hashed = F.concat(*[_placed(windows(F.col("w"), n), n) for n in lengths]) if lengths else None
    one = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("length"), F.lit(None).cast("long").alias("hash")))
    # the row at -1 stands for the document itself, so that documents without hits stay
    rows = base.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.inline(
        one if hashed is None else F.concat(one, hashed)))
    hashes = known.select(F.xxhash64("words").alias("hash"), "length").distinct().withColumn("known", F.lit(True))
    met = rows.join(hinted(hashes), ["hash", "length"], "left").where("pos < 0 OR known")
    found = F.when(F.col("pos") >= 0, F.struct("pos", "length"))
    by_doc = settle(met.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.sum((F.col("pos") < 0).cast("int")).alias("n_rows"),
        F.collect_set(found).alias("maybe")), "window-hits")

    # the few documents with hits once more, now word by word
    hit = by_doc.where(F.size("maybe") > 0).select("doc_id", "text_hash", "maybe")
    texts = (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").alias("d")
             .join(hit.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
                   & (F.col("d.text_hash") == F.col("h.text_hash")))
             .select("d.doc_id", "d.text_hash", "maybe", words(F.col("text")).alias("w")))
    read = texts.select("doc_id", "text_hash", F.inline(F.transform("maybe", lambda x: F.struct(
        x["pos"].alias("pos"), x["length"].alias("length"),
        F.slice(F.col("w"), x["pos"] + 1, x["length"]).alias("words")))))
    verified = read.join(hinted(known), ["length", "words"]).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("pos", "length")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    inside = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(
        x["pos"], x["pos"] + x["length"] - 1))))
    joined = by_doc.alias("b").join(verified.alias("v"), F.col("b.doc_id").eqNullSafe(F.col("v.doc_id"))
                                    & (F.col("b.text_hash") == F.col("v.text_hash")), "left")
    return (joined.select("b.doc_id", "b.text_hash", "n_words", "hits", "items", "n_rows")
            .withColumn("n_hit", F.when(F.col("hits").isNull(), 0).otherwise(F.size(inside)))
            .withColumn("n_rows", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).drop("n_rows"))


def _placed(hashes: Column, length: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), F.lit(length).alias("length"), h.alias("hash")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` without any hit word, whole and in their own columns."""
    flagged = contamination(docs, benchmark, size).where("n_hit > 0").select("doc_id", "text_hash").distinct()
    d, f = docs.alias("d"), flagged.alias("f")
    return d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.text_hash")), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    listed = F.concat_ws(",", F.sort_array(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
                        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                        F.sha2(F.coalesce(listed, F.lit("")), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
