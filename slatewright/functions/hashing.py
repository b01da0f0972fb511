"""Reproducible pseudo-randomness from md5, identical in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int, *parts: Column | str) -> Column:
    """``md5(seed:part:part...)`` as 32 hex digits; sort by it to shuffle."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def seeded_uniform(seed: int, *parts: Column | str) -> Column:
    """Uniform double in (0, 1) from the first eight hex digits of the key."""
    head = F.conv(F.substring(seeded_key(seed, *parts), 1, 8), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(4294967296.0)


def seeded_fraction(seed: int, *parts: Column | str) -> Column:
    """Uniform double in [0, 1) with 52 bits, for draws from long lists."""
    head = F.conv(F.substring(seeded_key(seed, *parts), 1, 13), 16, 10).cast("bigint")
    return head / F.lit(4503599627370496.0)
