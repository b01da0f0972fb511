"""Similarity of two item sets from their contingency counts.

a: items in both, b: only in the second, c: only in the first, d: in neither.
A zero denominator gives NULL unless the measure defines 0 for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def _ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def _margins(a, b, c, d):
    return (a + b) * (a + c) * (b + d) * (c + d)


def jaccard(a, b, c, d):
    return _ratio(a, a + b + c)


def stiles(a, b, c, d):
    n = a + b + c + d
    gap = F.abs(a * d - b * c) - n / 2
    inner = _ratio(n * gap * gap, _margins(a, b, c, d))
    return F.when(inner > 0, F.log10(inner))


def anderberg(a, b, c, d):
    best = F.greatest(a, b) + F.greatest(c, d) + F.greatest(a, c) + F.greatest(b, d)
    alone = F.greatest(a + c, b + d) + F.greatest(a + b, c + d)
    return _ratio(best - alone, 2 * (a + b + c + d))


def ample(a, b, c, d):
    return F.abs(_ratio_or_zero(a * (c + d), c * (a + b)))


def peirce(a, b, c, d):
    return _ratio_or_zero(a * b + b * c, a * b + 2 * b * c + c * d)


def yule_w(a, b, c, d):
    same, cross = F.sqrt(a * d), F.sqrt(b * c)
    return _ratio(same - cross, same + cross)


def tarantula(a, b, c, d):
    return _ratio_or_zero(a * (c + d), c * (a + b))


def simpson(a, b, c, d):
    return _ratio(a, F.least(a + b, a + c))


def eyraud(a, b, c, d):
    n = a + b + c + d
    return _ratio(n * n * (n * a - (a + b) * (a + c)), _margins(a, b, c, d))


def fager_mcgowan(a, b, c, d):
    return _ratio(a, F.sqrt((a + b) * (a + c))) - F.greatest(a + b, a + c) / 2


def driver_kroeber(a, b, c, d):
    return (a / 2) * (_ratio(F.lit(1.0), a + b) + _ratio(F.lit(1.0), a + c))


MEASURES: dict[str, Callable[..., Column]] = {
    "jaccard": jaccard, "stiles": stiles, "anderberg": anderberg, "ample": ample,
    "peirce": peirce, "yule_w": yule_w, "tarantula": tarantula, "simpson": simpson,
    "eyraud": eyraud, "fager_mcgowan": fager_mcgowan, "driver_kroeber": driver_kroeber,
}


def measure(name: str, both: Column, size_first: Column, size_second: Column,
            n_items: Column) -> Column:
    """Measure from the overlap, the two set sizes and the number of items."""
    if name not in MEASURES:
        raise ValueError(f"unknown similarity {name!r}; choose one of {sorted(MEASURES)}")
    a = both.cast("double")
    b = size_second.cast("double") - a
    c = size_first.cast("double") - a
    d = n_items.cast("double") - a - b - c
    return MEASURES[name](a, b, c, d)
