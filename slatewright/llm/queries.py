"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewright.llm import alignment, decontamination, imatch, jaccard, langid, mixing, oracles, sharding, spelling, substrings, suffixes, tokenfiles, toxicity, urlfilter
from slatewright.llm.shared import documents, settle, shared_path


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "ids")
    tokenfiles.write_ids(documents(spark, sf_dir), path, str(public_tokenizers.path("byte_bpe_50k.json")))
    return tokenfiles.digest(tokenfiles.read_ids(spark, path))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeated_words(documents(spark, sf_dir), width=20, keep_text=False)
    return left.select("doc_id", F.col("n_elements").alias("n_words"), "n_removed", "kept_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(documents(spark, sf_dir), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(documents(spark, sf_dir))
    return langid.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole documents are copied, shuffled and written; without that Spark would leave the texts out
    mixed = settle(mixing.mix(documents(spark, sf_dir)), "mixed")
    return mixed.select("doc_id", "source", "copy", F.round("rate", 9).alias("rate"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeated_bytes(documents(spark, sf_dir), width=400, keep_text=False)
    return left.select("doc_id", F.col("n_elements").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.digest(decontamination.contamination(documents(spark, sf_dir), benchmark, size=10))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(documents(spark, sf_dir), width=4, percent=85)


#: The rules of the query's contract.
URL_RULES = [
    urlfilter.Rule("allow", "com"), urlfilter.Rule("block", "example.com", "/en/"), urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"), urlfilter.Rule("block", "net", "/fr/"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels and pages share one space of ids: a page is bad if its label says toxic or of low quality
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes, URL_RULES)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    definitions = alignment.Definitions.read(*(str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    return alignment.corpus_digest(documents(spark, sf_dir), definitions)


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sharding": op3_sharding,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_url_filter": op11_url_filter,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_alignment": op13_alignment,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = dict(oracles.SQL)
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
