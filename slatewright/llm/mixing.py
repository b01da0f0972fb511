"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.llm.shared import settle

#: The share of the unit interval beyond the last tabulated count of a distribution.
TAIL_SIGMAS = 12


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None,
                 target_rows: int | None = None, temperature: float = 0.7) -> DataFrame:
    """(source, n_rows, rate): the mean repetitions that give the target mixture.

    ``weights`` gives the wanted share of each source (sources without an entry weigh 0);
    without it a source weighs its row count to the power ``temperature``. ``target_rows``
    is the expected size of the result, by default the size of the input. Shares are
    summed over sources only; their table has one row per source.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighed = counts.withColumn("_w", F.pow(F.col("n_rows").cast("double"), F.lit(float(temperature))))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        wanted = docs.sparkSession.createDataFrame(list(weights.items()), "source string, _w double")
        weighed = counts.join(wanted, "source", "left").fillna({"_w": 0.0})
    totals = weighed.agg(F.sum("_w").alias("_all"), F.sum("n_rows").alias("_size"))
    size = F.lit(target_rows).cast("double") if target_rows else F.col("_size").cast("double")
    # one row of totals: not a product of tables
    joined = weighed.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one")
    return joined.select("source", "n_rows", F.when(F.col("_all") > 0, size * F.col("_w") / F.col("_all")
                                                    / F.col("n_rows")).otherwise(F.lit(0.0)).alias("rate"))


def cumulative(rate) -> F.Column:
    """array of P(X <= k), k = 0, 1, ..., to TAIL_SIGMAS deviations beyond the mean; in logarithms, so
    that large means do not underflow."""
    last = F.ceil(rate + TAIL_SIGMAS * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"),
                     F.array(F.exp(-rate)).alias("below"))

    def step(state, k):
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"),
                        F.concat(state["below"], F.array(total)).alias("below"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["below"]).otherwise(
        F.array(F.lit(1.0)))


def _name(names: list[str], prefix: str = "") -> F.Column:
    """What a row is drawn by: its doc_id, or without one a hash of the whole row."""
    doc_id = F.col(f"{prefix}doc_id")
    return F.when(doc_id.isNotNull(), doc_id.cast("string")).otherwise(
        F.concat(F.lit("null|"), F.xxhash64(*[F.col(f"{prefix}{c}") for c in names]).cast("string")))


def replicated(docs: DataFrame, rates: DataFrame, seed: str = "mixing") -> DataFrame:
    """``docs`` with _copies: the Poisson quantile at a uniform number hashed from doc_id.

    The number of a row depends on seed, doc_id and source alone, so reruns, retries and
    other partitionings repeat it. Rows that repeat a doc_id repeat its number. Rows without
    doc_id have the number of their whole content.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), _name(docs.columns, "d."))), 1, 13), 16, 10)
    tables = rates.select(F.col("source").alias("_source"), "rate", cumulative(F.col("rate")).alias("_below"))
    joined = docs.alias("d").join(tables, F.col("d.source").eqNullSafe(F.col("_source")))
    return (joined.withColumn("_u", u.cast("double") / F.lit(float(1 << 52)))
            .withColumn("_copies", F.size(F.filter("_below", lambda c: c <= F.col("_u")))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None,
        temperature: float = 0.7, seed: str = "mixing") -> DataFrame:
    """Whole rows of ``docs``, each as often as drawn, in globally shuffled order, with copy.

    The order comes from a range shuffle by a hash of (seed, doc_id, copy): each partition
    of the result is a random part of the mixture and sorted by that hash. Null sources
    are a source of their own; null and empty texts are rows like others; an empty table
    stays empty. ``docs`` must not have columns that begin with an underscore or that are
    named rate or copy; those are replaced.
    """
    names = [c for c in docs.columns if not c.startswith("_") and c not in ("rate", "copy")]
    rates = settle(source_rates(docs, weights, target_rows, temperature), "rates")
    drawn = replicated(docs.select(*names), rates, seed).where("_copies > 0")
    copies = drawn.select(*[F.col(f"d.{c}") for c in names], "rate",
                          F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(seed + "-order"), _name(names), F.col("copy").cast("string")))
    return copies.withColumn("_key", key).orderBy("_key").drop("_key")
