"""Readers for logs, metadata, embeddings, recommendations and metrics."""

from __future__ import annotations

import ast
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewright.functions.text import between, between_or, clean_entities, strip_quotes
from slatewright.functions.vectors import parse_vector

# Column names and time format of the session files.
SESSION_SCHEMA = "SessionId long, ItemId long, Time timestamp_ntz, Reward double"
SESSION_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
# Markers of the fields in malformed metadata lines.
META_ID = ("'asin': '", "', '")
META_TITLE = ("'title':", ", '")
META_TITLE_END = "}"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, item_id, ts, reward`` from session CSV files."""
    raw = (spark.read.schema(SESSION_SCHEMA).option("header", True)
           .option("timestampNTZFormat", SESSION_TIME_FORMAT).csv(path))
    return raw.select(F.col("SessionId").alias("session_id"), F.col("ItemId").alias("item_id"),
                      F.col("Time").alias("ts"), F.col("Reward").alias("reward"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """``user, item, unix_time, reward`` from JSON-lines reviews."""
    schema = "reviewerID string, asin string, unixReviewTime long"
    return spark.read.schema(schema).json(path).select(
        F.col("reviewerID").alias("user"), F.col("asin").alias("item"),
        F.col("unixReviewTime").alias("unix_time"), F.lit(1.0).alias("reward"))


def parse_literals(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): lines holding Python-style dictionaries.

    The JSON reader understands single quotes; lines it rejects get a second try as
    Python literals (never evaluated), and what still fails is returned as it was.
    """
    struct = T._parse_datatype_string(schema)
    with_raw = T.StructType([*struct.fields, T.StructField("_bad", T.StringType())])
    options = {"allowSingleQuotes": "true", "mode": "PERMISSIVE",
               "columnNameOfCorruptRecord": "_bad"}
    first = lines.select("value", F.from_json("value", with_raw, options).alias("r"))
    is_bad = F.col("r").isNull() | F.col("r._bad").isNotNull()

    @F.pandas_udf("string")
    def as_json(values: pd.Series) -> pd.Series:
        def convert(text):
            try:
                return json.dumps(ast.literal_eval(text))
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None
        return values.map(convert)

    text = F.when(is_bad, as_json("value")).otherwise(F.col("value"))
    second = first.select("value", text.alias("_json")).select(
        "value", F.from_json("_json", with_raw, options).alias("r"))
    failed = F.col("r").isNull() | F.col("r._bad").isNotNull()
    good = second.where(~failed).select(*[F.col(f"r.{f.name}") for f in struct.fields])
    return good, second.where(failed).select("value")


def read_literal_lines(spark: SparkSession, path: str, schema: str
                       ) -> tuple[DataFrame, DataFrame]:
    return parse_literals(spark.read.text(path), schema)


def parse_metadata(lines: DataFrame) -> DataFrame:
    """``item, name`` from metadata lines that are not valid JSON."""
    value = F.col("value")
    title = strip_quotes(between_or(value, *META_TITLE, META_TITLE_END))
    return lines.select(between(value, *META_ID).alias("item"), clean_entities(title).alias("name"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return parse_metadata(spark.read.text(path))


def read_embeddings(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``item_id, name, embedding`` from CSV with JSON vectors.

    Compressed CSV is one task per file, so rows are spread before they are parsed.
    """
    raw = (spark.read.schema("ItemId long, name string, embedding string")
           .option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return raw.repartition(n).select(F.col("ItemId").alias("item_id"), "name",
                                     parse_vector("embedding").alias("embedding"))


def read_lookup(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of a CSV file with a header."""
    return spark.read.option("header", True).csv(path).select(*columns)


def read_recommendations(spark: SparkSession, path: str) -> DataFrame:
    """All stored runs below a folder; model and run time come from the folder names."""
    return spark.read.option("basePath", path).parquet(path)


def model_from_file(column: Column | None = None) -> Column:
    """Model name from a file name such as ``.../name-2023.parquet``."""
    source = column if column is not None else F.input_file_name()
    return F.regexp_extract(source, r"([^/]+?)(?:-\d[^/]*)?\.[A-Za-z.]+$", 1)


def read_metric_files(spark: SparkSession, paths: Sequence[str], schema: str,
                      required: Sequence[str]) -> DataFrame:
    """Rows of several metric CSV files, complete in the required columns."""
    frame = spark.read.schema(schema).option("header", True).csv(list(paths))
    return frame.na.drop(subset=list(required))
