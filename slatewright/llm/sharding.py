"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from slatewright.llm.shared import position


def assign_shards(docs: DataFrame, shards: int = 24, seed: str = "interleave") -> DataFrame:
    """Shards whose row counts differ by one at most and that all hold the sources' mixture.

    Rows are ranked in seeded random order within their source, ordered by fractional rank
    (rank + 0.5) / rows of the source, and cut into ``shards`` runs. Sorting is by ranges
    of (source, hash), so a source with a third of all rows is spread over tasks.

    Returns doc_id, source, size (UTF-8 bytes of the text plus 8), text_crc32, shard and
    slot (gapless from 0 in each shard). A null text counts as empty, a null source is a
    source of its own, repeated rows are told apart by their occurrence, an empty table
    gives no rows. Other columns of ``docs`` are ignored.
    """
    return _places(docs, shards, seed).select("doc_id", "source", "size", "text_crc32", "shard", "slot")


_SAME = ("doc_id", "source", "size", "text_crc32")


def _measures() -> list[Column]:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return [(F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")]


def _places(docs: DataFrame, shards: int, seed: str, *more: str) -> DataFrame:
    if shards < 1:
        raise ValueError("shards must be positive")
    light = docs.select("doc_id", "source", *_measures())
    same = Window.partitionBy(*_SAME).orderBy("doc_id")
    drawn = light.withColumn("_copy", F.row_number().over(same)).withColumn(
        "_draw", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                   F.col("_copy").cast("string"))))
    ranked = position(drawn, ["source", "_draw", "text_crc32", "size"], "_place", "shard-ranks")
    strata = ranked.groupBy("source").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    fraction = (F.col("_place") - F.col("_first") + 0.5) / F.col("_rows")
    joined = (ranked.alias("r").join(strata.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
              .select("r.doc_id", "r.source", "r.size", "r.text_crc32", "_draw", fraction.alias("_fraction"), *more))
    placed = position(joined, ["_fraction", "_draw", "source", "text_crc32"], "_place", "shard-order")
    total = F.lit(placed.count()).cast("long")
    shard = F.expr(f"_place * {shards} div _total").cast("int")
    return (placed.withColumn("_total", total).withColumn("shard", shard)
            .withColumn("slot", F.col("_place")
                        - F.expr(f"(shard * _total + {shards - 1}) div {shards}")))


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: str = "interleave") -> None:
    """The documents themselves as one folder per shard, in slot order within its files.

    All rows are written, each at a place that ``assign_shards`` gives, rows with repeated
    or null doc_id too: a row is the n-th one of its doc_id, source, size and checksum.
    Columns named shard or slot are replaced; ``docs`` must not have columns that begin
    with an underscore.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    places = _places(docs, shards, seed, "_copy").select(
        *[F.col(c).alias(f"_{c}") for c in _SAME], "_copy", "shard", "slot")
    measured = docs.select(*names, F.struct("doc_id", "source", *_measures()).alias("_same"))
    # rows that agree in the key may differ in other columns; their order must not change with a retry
    same = Window.partitionBy(*[f"_same.{c}" for c in _SAME]).orderBy(F.xxhash64(*names))
    rows, at = measured.withColumn("_copy", F.row_number().over(same)).alias("d"), places.alias("p")
    met = F.col("d._copy") == F.col("p._copy")
    for c in _SAME:
        met = met & F.col(f"d._same.{c}").eqNullSafe(F.col(f"p._{c}"))
    (rows.join(at, met).select(*[F.col(f"d.{c}") for c in names], "p.shard", "p.slot")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
