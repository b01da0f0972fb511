"""Dimensionality reduction of item vectors."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.functions.vectors import unit

METHODS = ("pca", "random", "lda")


def _dim(items: DataFrame) -> int:
    return items.select(F.size("embedding")).first()[0]


def reduce_pca(items: DataFrame, k: int) -> DataFrame:
    """Projection of the centred vectors on the first k principal axes.

    The covariance is aggregated over all tasks; only a d x d matrix reaches the driver.
    """
    vectors = items.withColumn("_v", array_to_vector("embedding"))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False)
    centred = centred.fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    return model.transform(centred).withColumn("embedding", vector_to_array("_p")).drop(
        "_v", "_c", "_p")


def _project(items: DataFrame, matrix: np.ndarray, shift: np.ndarray) -> DataFrame:
    """Multiply every vector by a d x k matrix that travels with the task."""
    d = matrix.shape[0]
    schema = items.select("embedding", *[c for c in items.columns if c != "embedding"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.schema
                       if f.name != "embedding")
    out_schema = "embedding array<double>" + (", " + fields if fields else "")

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = (x - shift) @ matrix
            offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            reduced = pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays(
                [reduced, *batch.columns[1:]], names=batch.schema.names)

    return schema.mapInArrow(run, out_schema).select(*items.columns)


def reduce_random(items: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Gaussian random projection with entries from N(0, 1/k), hashed from the seed and their place."""
    d = _dim(items)

    def uniform(*parts: int) -> float:
        return (int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0

    matrix = np.array([[math.sqrt(-2 * math.log(uniform(i, j, 0))) * math.cos(2 * math.pi * uniform(i, j, 1)) for j in range(k)]
                       for i in range(d)])
    return _project(items, matrix / math.sqrt(k), np.zeros(d))


def reduce_lda(items: DataFrame, k: int, label: str = "class") -> DataFrame:
    """Linear discriminant projection; k is cut to min(d, classes - 1).

    Per class the tasks sum vectors, per task they sum outer products, so the driver
    sees one d-vector per class and a d x d matrix.
    """
    d = _dim(items)

    def sums(batches):
        outer, totals = np.zeros(d * d), {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            outer += (x.T @ x).ravel()
            for c in np.unique(y):
                mine = x[y == c]
                total = totals.setdefault(int(c), np.zeros(d + 1))
                total += np.append(mine.sum(0), len(mine))
        # one row for the products and one a class
        yield pa.RecordBatch.from_arrays([pa.array([None, *totals], pa.int64()), pa.array([outer, *totals.values()], pa.list_(pa.float64()))],
                                         names=["grp", "sums"])

    rows = (items.select("embedding", F.col(label).cast("long")).mapInArrow(sums, "grp long, sums array<double>")
            .groupBy("grp").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).collect())
    means = {row["grp"]: row["sums"].toArray() for row in rows}
    outer = means.pop(None)
    counts = np.array([m[d] for m in means.values()])
    centres = np.array([m[:d] / m[d] for m in means.values()])
    n, k = counts.sum(), min(k, d, len(counts) - 1)
    centre = counts @ centres / n
    scatter = outer.reshape(d, d) - n * np.outer(centre, centre)
    spread = centres - centre
    between = (spread * counts[:, None]).T @ spread
    within = (scatter - between) / n + np.eye(d) * 1e-12
    lower = np.linalg.cholesky(within)
    inverse = np.linalg.inv(lower)
    values, axes = np.linalg.eigh(inverse @ (between / n) @ inverse.T)
    best = np.argsort(values)[::-1][:k]
    return _project(items, inverse.T @ axes[:, best], centre)


def normalise_rows(items: DataFrame) -> DataFrame:
    """Unit euclidean length; zero vectors stay."""
    return items.withColumn("embedding", unit("embedding"))


def reduce_embeddings(items: DataFrame, method: str, k: int, normalise: bool = False,
                      seed: int = 42, label: str = "class") -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose one of {METHODS}")
    if k < 1:
        raise ValueError("k must be positive")
    if method == "pca":
        out = reduce_pca(items, k)
    elif method == "random":
        out = reduce_random(items, k, seed)
    else:
        out = reduce_lda(items, k, label)
    return normalise_rows(out) if normalise else out


def configuration(method: str, k: int, normalise: bool = False, seed: int = 42) -> str:
    """The settings of a reduction as JSON."""
    return json.dumps({"method": method, "k": k, "normalise": normalise, "seed": seed})
