"""The prepared dataset most jobs start from: ordered log, split, prompts, truths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewright.operators import cases, splitting
from slatewright.plans import workload
from slatewright.sources.tables import stored


@dataclass(frozen=True)
class Dataset:
    """DataFrames of one split; ``folds`` holds ``session_id, fold, role`` if asked for."""

    log: DataFrame
    train: DataFrame
    test: DataFrame
    prompts: DataFrame
    truths: DataFrame
    folds: DataFrame | None = None
    items: DataFrame | None = None

    def case_ids(self) -> DataFrame:
        return self.prompts.where("pos = 1").select("case_id")

    def with_items(self, items: DataFrame) -> "Dataset":
        from dataclasses import replace
        return replace(self, items=items)

    def item_table(self) -> DataFrame | None:
        if self.items is None:
            print("no item table attached to this dataset")
        return self.items


def load_and_split(log: DataFrame, options: splitting.SplitOptions = splitting.SplitOptions(),
                   sample: int | None = None) -> Dataset:
    """Sample, split, filter, and cut the test sessions into prompts and truths."""
    if sample is not None:
        log = splitting.sample_sessions(log, sample, options.seed)
    labelled = splitting.with_roles(log, options.roles(log))
    train = labelled.where("role = 'train'").drop("role")
    test = labelled.where("role = 'test'").drop("role")
    if options.filter_non_trained:
        test = splitting.drop_untrained(train, test)
    cut = (cases.evolving_prompts, cases.evolving_truths) if options.evolving else \
        (cases.prompts, cases.ground_truths)
    return Dataset(log, train, test, cut[0](test, options.n_withheld),
                   cut[1](test, options.n_withheld),
                   options.folds(train) if options.num_folds else None)


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "log", lambda: workload.interactions(spark, sf_dir))


def dataset(spark: SparkSession, sf_dir: str, on_vectors: bool = False) -> Dataset:
    """The default split (last fifth of the sessions), each table written once.

    ``on_vectors`` folds the items onto the ids of the embedding table.
    """
    tag = "v_" if on_vectors else ""
    log = log_table(spark, sf_dir)
    if on_vectors:
        log = workload.on_vector_items(log, spark, sf_dir)
    options = splitting.SplitOptions()
    # roles depend on the sessions' times only, so both lanes share them
    roles = stored(spark, sf_dir, "roles", lambda: options.roles(log))

    def side(role: str) -> DataFrame:
        return splitting.with_roles(log, roles).where(F.col("role") == role).drop("role")

    train = stored(spark, sf_dir, tag + "train", lambda: side("train"))
    test = stored(spark, sf_dir, tag + "test", lambda: splitting.drop_untrained(train, side("test"))
                  if options.filter_non_trained else side("test"))
    return Dataset(log, train, test, cases.prompts(test), cases.ground_truths(test))
