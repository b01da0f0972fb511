"""Connected components of link tables by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.llm.shared import bring, settle


def connected(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links (x, y) lead to, for every node with a link.

    Large-star and small-star rounds: each node's neighbours are tied to the smallest one
    of them, until every node has one neighbour. Rounds grow with the logarithm of the
    longest path; each is written to the shared folder. Neighbours are never gathered:
    only their minimum is, summed up before the shuffle, and brought back to the edges of a
    node in as many tasks as it takes (``bring``): the smallest node holds all its component's.
    """
    edges = settle(links.where("x <> y").select("x", "y").distinct(), "edges")
    before, n_edges = None, edges.count()
    while True:
        # large star: the larger neighbours of a node go to its smallest one
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        large = bring(both.where("y > x"), ["x"], least, "n", ["m"], n_edges).select(F.col("y").alias("x"), F.col("m").alias("y"))
        # small star: a node and its smaller neighbours go to the smallest of them
        smaller = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct()
        least = smaller.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n"))
        small = bring(smaller, ["x"], least, "n", ["m"], n_edges).select(F.col("y").alias("x"), "m").where("x <> m")
        edges = settle(small.union(least.select("x", "m")).select("x", F.col("m").alias("y")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).union(
                edges.select(F.col("y").alias("node"), F.col("y").alias("component"))).distinct()
        before, n_edges = now, now["n"]
