"""Fixed-length item sequences as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewright.functions.hashing import seeded_uniform
from slatewright.functions.vectors import tail

PADDING = -1


def last_items(items: Column, n: int) -> Column:
    return tail(items, F.lit(n))


def padded(items: Column, length: int) -> Column:
    """Drop unknown ids, keep the last ``length``, fill up with -1 on the left."""
    kept = last_items(F.filter(items, lambda x: x != PADDING), length)
    filler = F.array_repeat(F.lit(PADDING).cast("long"), F.lit(length) - F.size(kept))
    return F.concat(filler, kept)


def next_item_input(sequence: Column, length: int) -> Column:
    return F.slice(sequence, 1, length)


def next_item_target(sequence: Column, length: int) -> Column:
    """Sequence shifted by one; masked where the input is padding."""
    return F.zip_with(F.slice(sequence, 1, length), F.slice(sequence, 2, length),
                      lambda x, y: F.when(x == PADDING, F.lit(PADDING).cast("long")).otherwise(y))


def only_last(sequence: Column, length: int) -> Column:
    """-1 everywhere but in the last place, which keeps the last element."""
    last = F.element_at(sequence, -1)
    return F.concat(F.array_repeat(F.lit(PADDING).cast("long"), length - 1), F.array(last))


def masked(sequence: Column, chosen, mask: Column) -> Column:
    """Replace chosen places by the mask id; padding is never chosen."""
    return F.transform(sequence, lambda x, i: F.when((x != PADDING) & chosen(i), mask).otherwise(x))


def masked_target(sequence: Column, chosen) -> Column:
    """Keep chosen items, -1 elsewhere."""
    return F.transform(sequence, lambda x, i: F.when((x != PADDING) & chosen(i), x)
                       .otherwise(F.lit(PADDING).cast("long")))


def at_random(prob: float, seed: int, *key: Column | str):
    """Choose each place with probability ``prob``, reproducibly per key."""
    return lambda i: seeded_uniform(seed, *key, i) < F.lit(prob)


def at_end(length: int):
    return lambda i: i == F.lit(length - 1)


def shifted_with_mask(sequence: Column, length: int, mask: Column) -> Column:
    """Drop the oldest place and append the mask id."""
    return F.concat(F.slice(sequence, 2, length - 1), F.array(mask))
