"""Helpers of the training-data operators: written intermediates and global order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewright.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that the cluster names."""
    return (f"{ensure_checkpoint_dir(spark)}/llm/{spark.sparkContext.applicationId}/"
            f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: lineage is cut, and a
    lost executor costs a reread, not a second evaluation."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def position(df: DataFrame, keys: list[str | Column], column: str, name: str) -> DataFrame:
    """``df`` settled with a gapless position from 0 in the order of ``keys``.

    A range shuffle sorts; the rows of the partitions before it shift a partition's own
    numbers. No task sees more than its range: the only single-task step adds up one
    count per partition. Rows that agree in all keys may take each other's place.
    """
    sorted_rows = df.orderBy(*keys).withColumn("_mark", F.monotonically_increasing_id())
    marked = settle(sorted_rows, name)
    part = F.shiftright(F.col("_mark"), 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    return (marked.withColumn("_part", part).join(shifts, "_part")
            .withColumn(column, F.col("_shift") + F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_mark", "_shift"))


#: A key with more than a HEAVY-th of all rows is heavy; fewer than HEAVY keys can be.
HEAVY = 1000


def bring(rows: DataFrame, keys: list[str], table: DataFrame, size: str, values: list[str], total: int | None = None) -> DataFrame:
    """``rows`` with the ``values`` that ``table`` has for their ``keys``, null where it has none. ``table`` has one row
    a key, and ``size``, its number of rows; ``total`` is their sum, if known.

    Keys with more than a HEAVY-th of the rows, so fewer than HEAVY, are broadcast; the rows of all others are
    shuffled to their values. Rows of heavy keys pass that shuffle under keys that belong to nobody.
    """
    if total is None:
        total = table.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) * HEAVY > F.lit(int(total))
    at_once = F.broadcast(table.where(heavy).select(*keys, F.struct(*values).alias("_heavy")))
    others = table.where(~heavy).select(*keys, F.lit(0).alias("_salt"), F.struct(*values).alias("_light"))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int") + 1
    marked = rows.join(at_once, keys, "left").withColumn("_salt", F.when(F.col("_heavy").isNotNull(), spread).otherwise(0))
    found = marked.join(others, [*keys, "_salt"], "left").withColumn("_value", F.coalesce("_heavy", "_light"))
    return found.select(*rows.columns, *[F.col(f"_value.{v}").alias(v) for v in values])


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_path`` gave, once all that was read from it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``.

    A threshold that leaves a few more than wanted comes first, so that neither the
    tasks nor the one that cuts the rest hold more than some multiple of ``most`` together.
    """
    n = rows.count()
    if n > most:
        kept = int((1 << 62) * min(1.0, 1.2 * (most + 100) / n))
        rows = rows.where(F.shiftrightunsigned(F.xxhash64(key), 2) < kept)
    return rows.orderBy(F.shiftrightunsigned(F.xxhash64(key), 2), key).limit(most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
