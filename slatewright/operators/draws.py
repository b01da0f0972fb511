"""Random draws of single cases without all their candidates.

A draw is a number of a case, hashed with the seed to a place on a line on which the candidates lie
end to end, each as long as its weight. So draws depend on nothing but seed, case and number, and
more of them can be made when the first ones were not enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.functions.hashing import seeded_fraction, seeded_uniform
from slatewright.operators.ranking import running_total, spread, top_n
from slatewright.session import cut_lineage

#: Up to so many candidates for each one wanted, each case compares all candidates.
RACE_FACTOR = 8
#: Buckets that one row lists at once.
CHUNK = 4096


def drawn_points(waiting: DataFrame, key: str, total: str, seed: int, start: int, stop: int) -> DataFrame:
    """``key, draw, x``: draws ``start`` to ``stop`` - 1 of each row, with ``x`` from 0 to ``total`` - 1."""
    draws = spread(waiting, key).withColumn("draw", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(stop - 1).cast("long"))))
    return draws.select(key, "draw", F.floor(seeded_fraction(seed, key, "draw") * F.col(total)).cast("long").alias("x"))


def drawn_places(waiting: DataFrame, spans: DataFrame, key: str, total: str, size: str, seed: int, start: int, stop: int) -> DataFrame:
    """Draws of each case among its own ``spans`` (key, item_id, lo, size): ``key, draw, item_id, size, place``."""
    points = drawn_points(waiting, key, total, seed, start, stop)
    own = spans.withColumnRenamed(key, "_key")
    inside = (F.col(key) == F.col("_key")) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("lo") + F.col(size))
    # draws are far more than the rows they were made from, by whose size Spark would broadcast them
    return points.join(own.hint("merge"), inside).select(key, "draw", "item_id", size, (F.col("x") - F.col("lo")).alias("place"))


def line_of_items(items: DataFrame, weight: str) -> tuple[DataFrame, int, int]:
    """(``_bucket, item_id, lo, hi``, length of the line, width of a bucket): the items end to end in the order of their
    ids, listed under each bucket of the line that they reach.

    There are about as many buckets as items, so a point meets as many items as their mean weight at most, and an item
    of any weight stands under no more buckets than there are.
    """
    line = cut_lineage(running_total(items.select("item_id", F.col(weight).cast("long").alias("_w")).where("_w > 0"),
                                     [F.col("item_id")], "_w", "lo"))
    total, n = line.agg(F.coalesce(F.sum("_w"), F.lit(0)), F.count(F.lit(1))).first()
    width = max(1, total // max(1, n))
    first, last = F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("_w") - 1) / width)
    # in two steps, so that an item with half of all weight is no list of half of all buckets
    chunks = line.select("item_id", "lo", (F.col("lo") + F.col("_w")).alias("hi"), first.alias("_first"), last.alias("_last"),
                         F.explode(F.sequence(F.floor(first / CHUNK), F.floor(last / CHUNK))).alias("_chunk"))
    own = F.sequence(F.greatest("_first", F.col("_chunk") * CHUNK), F.least("_last", F.col("_chunk") * CHUNK + (CHUNK - 1)))
    return chunks.select("item_id", "lo", "hi", F.explode(own).alias("_bucket")), int(total), width


def negative_samples(cases: DataFrame, item_counts: DataFrame, n: int, seed: int, weighted: bool = True) -> DataFrame:
    """``case_id, item_id``: for each case a sample of its own of ``n`` items without replacement.

    Items are drawn one after the other with a chance in proportion to their ``count`` (or, not ``weighted``, all
    alike), by rejecting repeats: each case draws 3/2 ``n`` places on the line of all items, and those that repeated
    too often draw twice as many in the next round. With at most RACE_FACTOR * n items a case compares all of them
    in an exponential race instead (the n smallest of ``-ln(u) / weight``), which has the same law and no repeats.
    Items without count are never drawn; fewer than n items are all drawn.
    """
    weights = item_counts.select("item_id", (F.col("count") if weighted else F.lit(1)).cast("long").alias("_weight")).where("_weight > 0")
    wanted = cases.select("case_id").distinct()
    if weights.limit(RACE_FACTOR * n + 1).count() <= RACE_FACTOR * n:
        # one row a case and item, of which there are RACE_FACTOR * n at most
        listed = weights.agg(F.collect_list(F.struct("item_id", "_weight")).alias("_all"))
        each = spread(wanted, "case_id").join(F.broadcast(listed)).select("case_id", F.inline("_all"))
        key = F.round(F.log(-F.log(seeded_uniform(seed, "case_id", "item_id"))) - F.log(F.col("_weight")), 9)
        return top_n(each.withColumn("_key", key), ["case_id"], [F.col("_key"), F.col("item_id")], n).select("case_id", "item_id")
    line, total, width = line_of_items(weights, "_weight")
    waiting = wanted.withColumn("_total", F.lit(total))
    found, start, size = None, 0, n + (n + 1) // 2
    while True:
        points = drawn_points(waiting, "case_id", "_total", seed, start, start + size).withColumn("_bucket", F.floor(F.col("x") / width))
        # as in drawn_places: Spark would judge the draws by the size of the cases, and broadcast them
        hits = points.join(line.hint("merge"), "_bucket").where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
        new = hits.select("case_id", "item_id", "draw")
        firsts = (new if found is None else found.unionByName(new)).groupBy("case_id", "item_id").agg(F.min("draw").alias("draw"))
        found, start, size = cut_lineage(firsts), start + size, 2 * size
        enough = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
        waiting = cut_lineage(waiting.join(enough, "case_id", "left_anti"))
        if waiting.isEmpty():
            return top_n(found, ["case_id"], [F.col("draw")], n).select("case_id", "item_id")
