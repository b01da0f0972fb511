"""Recency weights by position in a session.

``i`` is the position from the end (1 = latest) and ``n`` the session length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors of the linear forms in the two places that use decays.
NEIGHBOUR_FLOOR = 1e-4
EMBEDDING_FLOOR = 1e-5

# Accepted names and their aliases.
ALIASES = {"linear": "constant_linear", "quadratic": "harmonic_squared",
           "squared_harmonic": "harmonic_squared"}
NAMES = ("constant_linear", "scaling_linear", "scaling_quadratic", "scaling_cubic",
         "log", "harmonic", "harmonic_squared")


def check_decay(name: str | None) -> str | None:
    if name is None:
        return None
    name = ALIASES.get(name, name)
    if name not in NAMES:
        raise ValueError(f"unknown decay {name!r}; choose one of {NAMES}")
    return name


def decay_weight(name: str | None, pos: Column, n: Column,
                 floor: float = EMBEDDING_FLOOR) -> Column:
    """Weight of the item at 1-based ``pos`` in a session of ``n`` items."""
    name = check_decay(name)
    i = (n - pos + 1).cast("double")
    if name is None:
        return F.lit(1.0)
    if name == "constant_linear":
        return F.greatest(F.lit(floor), F.lit(1.0) - (i - 1.0) * 0.1)
    if name.startswith("scaling"):
        slope = F.greatest(F.lit(floor), F.lit(1.0) - (i - 1.0) * (F.lit(1.0) / n))
        if name == "scaling_linear":
            return slope
        return slope * slope if name == "scaling_quadratic" else slope * slope * slope
    if name == "log":
        return F.lit(1.0) / (F.log(i) + 1.0)
    if name == "harmonic":
        return F.lit(1.0) / i
    return F.lit(1.0) / (i * i)


# Weight names counted from the start of the session.
START_WEIGHTS = ("CONSTANT", "LINEAR", "QUADRATIC", "CUBIC", "LAST_ONLY")


def start_weight(name: str, pos: Column, n: Column) -> Column:
    """Weights that grow with the position from the start."""
    p = pos.cast("double")
    if name == "CONSTANT":
        return F.lit(1.0)
    if name == "LINEAR":
        return p
    if name == "QUADRATIC":
        return p * p
    if name == "CUBIC":
        return p * p * p
    if name == "LAST_ONLY":
        return F.when(pos == n, 1.0).otherwise(0.0)
    raise ValueError(f"unknown weight {name!r}; choose one of {START_WEIGHTS}")
