"""Train / test / validation splits over whole sessions.

All splits label sessions first (one row per session) and join the label back to the
interaction rows, so ordering work never touches the interaction table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewright.functions.hashing import seeded_key
from slatewright.operators.ranking import rank_overall, rank_within


def session_times(log: DataFrame) -> DataFrame:
    """``session_id, max_ts``: a session happens when its last row happens."""
    return log.groupBy("session_id").agg(F.max("ts").alias("max_ts"))


def sessions_in_time(log: DataFrame) -> DataFrame:
    """``session_id, max_ts, session_rank`` with rank 1 for the earliest session."""
    return rank_overall(session_times(log), [F.col("max_ts"), F.col("session_id")],
                        name="session_rank")


def shuffled_sessions(log: DataFrame, seed: int) -> DataFrame:
    """``session_id, session_rank`` in a reproducible random order."""
    keyed = log.select("session_id").distinct().withColumn(
        "_key", seeded_key(seed, "session_id"))
    return rank_overall(keyed, [F.col("_key"), F.col("session_id")],
                        name="session_rank").drop("_key")


def _count(sessions: DataFrame) -> int:
    return sessions.count()


def _require_both(sessions: DataFrame) -> DataFrame:
    roles = {r["role"] for r in sessions.select("role").distinct().collect()}
    if roles != {"train", "test"}:
        raise ValueError("the cut-off leaves the train or the test side empty")
    return sessions


def temporal_split_fraction(log: DataFrame, test_frac: float) -> DataFrame:
    """``session_id, role``: the latest ``ceil(test_frac * n)`` sessions are test."""
    if not 0 < test_frac < 1:
        raise ValueError(f"test_frac must lie in (0, 1), got {test_frac}")
    ranked = sessions_in_time(log)
    n = _count(log.select("session_id").distinct())
    first_test = n - math.ceil(test_frac * n) + 1
    return ranked.select("session_id", F.when(F.col("session_rank") >= first_test, "test")
                         .otherwise("train").alias("role"))


def as_timestamp(value: datetime | float | str) -> Column:
    """A literal cut-off from a datetime, an ISO string or epoch seconds (UTC)."""
    if isinstance(value, (int, float)):
        value = datetime.fromtimestamp(value, tz=timezone.utc).replace(tzinfo=None)
    return F.lit(str(value)).cast("timestamp_ntz")


def temporal_split_cutoff(log: DataFrame, cutoff, check: bool = True) -> DataFrame:
    """``session_id, role``: sessions ending at or after ``cutoff`` are test."""
    late = F.col("max_ts") >= as_timestamp(cutoff)
    roles = session_times(log).select(
        "session_id", F.when(late, "test").otherwise("train").alias("role"))
    return _require_both(roles) if check else roles


def random_split(log: DataFrame, test_frac: float, seed: int) -> DataFrame:
    """``session_id, role``: the first ``int((1 - f) * n)`` shuffled sessions train."""
    ranked = shuffled_sessions(log, seed)
    n = _count(log.select("session_id").distinct())
    n_train = int((1 - test_frac) * n)
    return ranked.select("session_id", F.when(F.col("session_rank") <= n_train, "train")
                         .otherwise("test").alias("role"))


def even_bins(ranked: DataFrame, n_rows: int, bins: int, rank: str = "session_rank",
              name: str = "bin") -> DataFrame:
    """Cut 1..n into ``bins`` runs whose sizes differ by at most one, larger first."""
    size, extra = divmod(n_rows, bins)
    zero_based = F.col(rank) - 1
    wide = (size + 1) * extra
    label = F.when(zero_based < wide, F.floor(zero_based / F.lit(size + 1)))
    if size:
        label = label.otherwise(extra + F.floor((zero_based - wide) / F.lit(size)))
    return ranked.withColumn(name, (label + 1).cast("int"))


def random_folds(log: DataFrame, num_folds: int, seed: int) -> DataFrame:
    """``session_id, fold, role``: fold i validates on the i-th shuffled bucket."""
    ranked = shuffled_sessions(log, seed)
    n = _count(log.select("session_id").distinct())
    binned = even_bins(ranked, n, num_folds)
    folds = F.explode(F.sequence(F.lit(1), F.lit(num_folds)))
    return binned.withColumn("fold", folds).select(
        "session_id", "fold",
        F.when(F.col("bin") == F.col("fold"), "validation").otherwise("train").alias("role"))


def chain_bins(binned: DataFrame, num_folds: int) -> DataFrame:
    """Forward chaining: fold i trains on bins up to i and validates on bin i + 1."""
    first = F.greatest(F.col("bin") - 1, F.lit(1))
    folds = F.explode(F.sequence(first, F.lit(num_folds)))
    return binned.where(F.col("bin") <= num_folds + 1).withColumn("fold", folds).select(
        "session_id", "fold",
        F.when(F.col("bin") <= F.col("fold"), "train").otherwise("validation").alias("role"))


def forward_chaining_folds(log: DataFrame, num_folds: int) -> DataFrame:
    """``session_id, fold, role`` over ``num_folds + 1`` equal time bins."""
    ranked = sessions_in_time(log)
    n = _count(log.select("session_id").distinct())
    if n < num_folds + 1:
        raise ValueError(f"{n} sessions cannot fill {num_folds + 1} time bins")
    return chain_bins(even_bins(ranked, n, num_folds + 1), num_folds)


def cutoff_bins(log: DataFrame, cutoffs: Sequence) -> DataFrame:
    """``session_id, max_ts, bin``: 1 + the number of cut-offs at or before the end."""
    passed = F.lit(0)
    for cutoff in cutoffs:
        passed = passed + (F.col("max_ts") >= as_timestamp(cutoff)).cast("int")
    return session_times(log).withColumn("bin", passed + 1)


def cutoff_folds(log: DataFrame, cutoffs: Sequence, check: bool = True) -> DataFrame:
    """``session_id, fold, role`` chained over the bins between sorted cut-offs."""
    binned = cutoff_bins(log, cutoffs)
    if check:
        filled = binned.select("bin").distinct().count()
        if filled != len(cutoffs) + 1:
            raise ValueError("a bin between the fold cut-offs holds no session")
    return chain_bins(binned, len(cutoffs))


@dataclass(frozen=True)
class SplitOptions:
    """How to split: by time (fraction or cut-off) or at random, and how to fold."""

    strategy: str = "temporal"
    test_frac: float | None = 0.2
    test_cutoff: object | None = None
    num_folds: int = 0
    fold_strategy: str = "chain"
    fold_cutoffs: tuple = field(default_factory=tuple)
    filter_non_trained: bool = True
    n_withheld: int = 1
    evolving: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.strategy not in ("temporal", "random"):
            raise ValueError(f"unknown split strategy {self.strategy!r}")
        if self.fold_strategy not in ("chain", "cross", "cutoff"):
            raise ValueError(f"unknown fold strategy {self.fold_strategy!r}")
        if (self.test_frac is None) == (self.test_cutoff is None):
            raise ValueError("give exactly one of test_frac and test_cutoff")
        if self.strategy == "random" and self.test_cutoff is not None:
            raise ValueError("a cut-off needs the temporal strategy")
        if self.test_frac is not None and not 0 < self.test_frac < 1:
            raise ValueError("test_frac must lie in (0, 1)")
        if self.fold_strategy == "cutoff" and self.num_folds and \
                len(self.fold_cutoffs) != self.num_folds:
            raise ValueError("one cut-off per fold is required")
        if self.n_withheld < 1:
            raise ValueError("n_withheld must be a positive integer")
        if self.num_folds < 0:
            raise ValueError("num_folds must not be negative")

    def roles(self, log: DataFrame) -> DataFrame:
        if self.strategy == "random":
            return random_split(log, self.test_frac, self.seed)
        if self.test_cutoff is not None:
            return temporal_split_cutoff(log, self.test_cutoff)
        return temporal_split_fraction(log, self.test_frac)

    def folds(self, log: DataFrame) -> DataFrame:
        if self.strategy == "random" or self.fold_strategy == "cross":
            return random_folds(log, self.num_folds, self.seed)
        if self.fold_strategy == "cutoff":
            return cutoff_folds(log, self.fold_cutoffs)
        return forward_chaining_folds(log, self.num_folds)


def with_roles(log: DataFrame, roles: DataFrame) -> DataFrame:
    """Interaction rows labelled with the role (and fold) of their session."""
    return log.join(roles, "session_id")


def drop_untrained(train: DataFrame, test: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test rows whose item occurs in train, then sessions still holding two rows.

    Positions are renumbered, since dropped rows leave gaps.  ``keys`` (for instance
    ``fold``) restrict the comparison to rows of the same group.
    """
    keys = list(keys)
    seen = train.select(*keys, "item_id").distinct()
    kept = test.join(seen, [*keys, "item_id"], "left_semi")
    enough = kept.groupBy(*keys, "session_id").count().where("count >= 2").drop("count")
    lengths = test.groupBy(*keys, "session_id").agg(F.max("pos").alias("_rows"))
    return close_gaps(kept.join(enough, [*keys, "session_id"], "left_semi"), keys, lengths)


def close_gaps(log: DataFrame, keys: Sequence[str] = (),
               sizes: DataFrame | None = None) -> DataFrame:
    """Positions 1..n again per session, in the old order; long sessions are split."""
    return rank_within(log.withColumnRenamed("pos", "_old"), [*keys, "session_id"],
                       [F.col("_old")], sizes=sizes).drop("_old")


def inner_validation(log: DataFrame, fraction: float, seed: int,
                     at_most: int | None = None) -> DataFrame:
    """``session_id, role``: random sessions held back for early stopping, ``at_most`` so many."""
    ranked = shuffled_sessions(log, seed)
    n = _count(log.select("session_id").distinct())
    n_val = math.ceil(fraction * n)
    n_val = n_val if at_most is None else min(n_val, at_most)
    return ranked.select("session_id", F.when(F.col("session_rank") <= n_val, "validation")
                         .otherwise("train").alias("role"))


def inner_validation_cases(log: DataFrame, fraction: float, seed: int, at_most: int | None = 500, n_withheld: int = 1
                           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training rows, prompts, truths) of :func:`inner_validation`: what early stopping is judged on.

    The held-back sessions are cut as test sessions are: their items that no training session holds go, then
    sessions left with fewer than two rows; the last ``n_withheld`` items are the truth.
    """
    from slatewright.operators import cases

    labelled = with_roles(log, inner_validation(log, fraction, seed, at_most))
    train = labelled.where("role = 'train'").drop("role")
    held = drop_untrained(train, labelled.where("role = 'validation'").drop("role"))
    return train, cases.prompts(held, n_withheld), cases.ground_truths(held, n_withheld)


def sample_sessions(log: DataFrame, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` sessions drawn without replacement."""
    available = _count(log.select("session_id").distinct())
    if n > available:
        raise ValueError(f"cannot sample {n} of {available} sessions")
    keep = shuffled_sessions(log, seed).where(F.col("session_rank") <= n).select("session_id")
    return log.join(keep, "session_id", "left_semi")
