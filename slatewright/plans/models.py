"""Recommenders behind one interface: ``fit(train, items)``, then ``recommend(prompts, k)``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewright.operators import cases, splitting
from slatewright.operators import evaluation as E
from slatewright.operators.embedding import SimilarityOptions, recommend_similar
from slatewright.operators.evolving import recommend_similar_evolving
from slatewright.operators.hybrids import diversity_filter, rank_ensemble
from slatewright.operators.index import NeighbourIndex
from slatewright.operators.metrics import Metric
from slatewright.operators.neighbours import NeighbourOptions, recommend_neighbours
from slatewright.operators.popularity import item_counts, recommend_popular
from slatewright.operators.reduction import reduce_embeddings
from slatewright.plans.prepared import Dataset
from slatewright.session import ensure_checkpoint_dir


class Recommender(Protocol):
    def fit(self, train: DataFrame, items: DataFrame | None = None) -> "Recommender": ...

    def recommend(self, prompts: DataFrame, k: int) -> DataFrame: ...


class Reranker(Protocol):
    def rerank(self, recs: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class Popular:
    name: str = "popular"
    train: DataFrame | None = field(default=None, repr=False)

    def fit(self, train, items=None):
        return replace(self, train=train)

    def recommend(self, prompts, k):
        return recommend_popular(self.train, prompts.where("pos = 1").select("case_id"), k, self.name)

    def recommend_evolving(self, test, k, n_withheld=1):
        return recommend_popular(self.train, cases.evolving_cases(test, n_withheld).select("case_id"), k, self.name)


@dataclass(frozen=True)
class Neighbours:
    """Session neighbours over a stored index; ``path`` says where it is kept, by default the shared folder."""

    options: NeighbourOptions = NeighbourOptions()
    name: str | None = None
    path: str | None = None
    index: NeighbourIndex | None = field(default=None, repr=False)
    items: DataFrame | None = field(default=None, repr=False)

    def fit(self, train, items=None):
        path = self.path or f"{ensure_checkpoint_dir(train.sparkSession)}/neighbours/{uuid.uuid4().hex}"
        return replace(self, path=path, index=NeighbourIndex.fit(train, path), items=items)

    def load(self, spark: SparkSession, items=None):
        """The model whose index was stored below ``path`` before."""
        return replace(self, index=NeighbourIndex.load(spark, self.path), items=items)

    def recommend(self, prompts, k):
        return recommend_neighbours(prompts, self.index, k, self.options, self.items, self.name)

    def recommend_evolving(self, test, k, n_withheld=1):
        """Linear in the log where ``last_n_items`` says how much of a prefix counts."""
        return self.recommend(cases.evolving_prompts(test, n_withheld, self.options.last_n_items), k)


@dataclass(frozen=True)
class Similar:
    """Nearest items of the session vector, with reduced item vectors if asked for."""

    options: SimilarityOptions = SimilarityOptions()
    reduce: str | None = None
    dims: int = 512
    name: str = "similar"
    items: DataFrame | None = field(default=None, repr=False)

    def fit(self, train, items=None):
        if items is None:
            raise ValueError("this model needs an item table with embeddings")
        if self.reduce is not None:
            items = reduce_embeddings(items, self.reduce, self.dims)
        return replace(self, items=items)

    def recommend(self, prompts, k):
        return recommend_similar(prompts, self.items, k, self.options, self.name)

    def recommend_evolving(self, test, k, n_withheld=1):
        return recommend_similar_evolving(test, self.items, k, self.options, n_withheld, self.name)


def run_models(models: Sequence[Recommender], data: Dataset, top_ks: Sequence[int] = (10, 20),
               metrics: Sequence[str | Metric] = E.DEFAULT_METRICS) -> DataFrame:
    """Fit, recommend and evaluate several models on one split: one report table."""
    recs = None
    for model in models:
        part = model.fit(data.train, data.items).recommend(data.prompts, max(top_ks))
        recs = part if recs is None else recs.unionByName(part)
    counts = item_counts(data.train)
    return E.evaluate(recs, data.truths, top_ks, metrics, item_counts=counts,
                      n_items=counts.agg(F.count(F.lit(1))).scalar())


def run_evolving(models: Sequence[Recommender], data: Dataset, top_ks: Sequence[int] = (10, 20),
                 metrics: Sequence[str | Metric] = E.DEFAULT_METRICS, n_withheld: int = 1) -> DataFrame:
    """As :func:`run_models`, with every prefix of a test session as a case.

    A model with ``recommend_evolving`` reads the sessions themselves; others get the prefixes written out.
    """
    recs = None
    for model in models:
        fitted = model.fit(data.train, data.items)
        own = getattr(fitted, "recommend_evolving", None)
        part = (own(data.test, max(top_ks), n_withheld) if own is not None
                else fitted.recommend(cases.evolving_prompts(data.test, n_withheld), max(top_ks)))
        recs = part if recs is None else recs.unionByName(part)
    counts = item_counts(data.train)
    return E.evaluate(recs, cases.evolving_truths(data.test, n_withheld), top_ks, metrics, item_counts=counts,
                      n_items=counts.agg(F.count(F.lit(1))).scalar())


def run_folds(models: Sequence[Recommender], data: Dataset, folds: DataFrame,
              top_ks: Sequence[int] = (10, 20), metrics: Sequence[str | Metric] = E.DEFAULT_METRICS,
              n_withheld: int = 1) -> tuple[DataFrame, DataFrame]:
    """(reports with ``fold``, their means) over ``folds`` (``session_id, fold, role``).

    Every fold fits on its own training sessions and is judged on its validation
    sessions, without items that it has not trained. Folds are a handful, and each is a
    whole run.
    """
    reports = None
    for fold in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        labelled = splitting.with_roles(data.train, folds.where(F.col("fold") == fold).drop("fold"))
        train = labelled.where("role = 'train'").drop("role")
        test = splitting.drop_untrained(train, labelled.where("role = 'validation'").drop("role"))
        part = Dataset(data.train, train, test, cases.prompts(test, n_withheld),
                       cases.ground_truths(test, n_withheld), items=data.items)
        report = run_models(models, part, top_ks, metrics).withColumn("fold", F.lit(fold))
        reports = report if reports is None else reports.unionByName(report)
    return reports, E.average_reports(reports)


@dataclass(frozen=True)
class Diverse:
    """Re-ranker: an item too like one kept before it goes."""

    items: DataFrame = field(repr=False)
    threshold: float = 0.2

    def rerank(self, recs, k):
        kept = diversity_filter(recs, self.items, [self.threshold], k, ("model", "case_id"))
        return kept.drop("param").join(recs.select("model", "case_id", "item_id", "score"), ["model", "case_id", "item_id"])


@dataclass(frozen=True)
class Reranked:
    """A recommender whose slates of ``pool`` items a re-ranker cuts to k."""

    model: Recommender
    reranker: Reranker
    pool: int = 100

    def fit(self, train, items=None):
        return replace(self, model=self.model.fit(train, items))

    def recommend(self, prompts, k):
        return self.reranker.rerank(self.model.recommend(prompts, max(self.pool, k)), k)


@dataclass(frozen=True)
class Ensemble:
    """Two recommenders as one slate: the first ``r`` ranks of one, then the other's."""

    first: Recommender
    second: Recommender
    r: int = 5
    name: str = "ensemble"

    def fit(self, train, items=None):
        return replace(self, first=self.first.fit(train, items), second=self.second.fit(train, items))

    def recommend(self, prompts, k):
        slates = [m.recommend(prompts, k).drop("model", "score") for m in (self.first, self.second)]
        merged = rank_ensemble(*slates, [self.r], k).where(F.col("param") == self.r).drop("param")
        return merged.select(F.lit(self.name).alias("model"), "case_id", "rank", "item_id",
                             (F.lit(1.0) / F.col("rank")).alias("score"))


def run_trials(make: Callable[[int], Recommender], data: Dataset, n_trials: int = 5,
               top_ks: Sequence[int] = (10, 20)) -> tuple[DataFrame, DataFrame]:
    """(reports with ``trial``, best trial by NDCG at 20) of a model with a seed."""
    reports = None
    for trial in range(n_trials):
        report = run_models([make(trial)], data, top_ks, E.RANKING).withColumn("trial", F.lit(trial))
        reports = report if reports is None else reports.unionByName(report)
    return reports, E.best_trial(reports)
