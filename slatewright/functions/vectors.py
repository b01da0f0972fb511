"""Arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column | str, y: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0),
                       lambda total, v: total + v)


def squared_norm(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.aggregate(x, F.lit(0.0), lambda total, v: total + v * v)


def norm(x: Column | str) -> Column:
    return F.sqrt(squared_norm(x))


def cosine(x: Column | str, y: Column | str) -> Column:
    """0 when one side has no length."""
    lengths = norm(x) * norm(y)
    return F.when(lengths > 0, dot(x, y) / lengths).otherwise(F.lit(0.0))


def unit(x: Column | str) -> Column:
    """Divide by the euclidean norm; zero vectors stay as they are."""
    column = F.col(x) if isinstance(x, str) else x
    length = norm(column)
    return F.when(length > 0, F.transform(column, lambda v: v / length)).otherwise(column)


def scale(x: Column, factor: Column) -> Column:
    return F.transform(x, lambda v: v * factor)


def tail(x: Column, n: Column) -> Column:
    """The last ``n`` elements (all of them when there are fewer)."""
    return F.slice(x, F.greatest(F.lit(1), F.size(x) - n + 1), n)


def parse_vector(text: Column | str) -> Column:
    """``"[0.1, 0.2]"`` to ``array<double>``."""
    return F.from_json(text, "array<double>")
