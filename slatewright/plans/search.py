"""Search of a model and a property cut-off over time folds, and its report on the test sessions.

Each candidate fits on a fold's training sessions and recommends for its validation sessions more
items than are shown, because a property drops some. All cut-offs of the property are columns of one
job; candidates and folds are a handful. The best mean over the folds decides, the winner is fitted on
all training sessions, and only its cut-off is judged on the test sessions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewright.operators import cases, splitting, stats
from slatewright.operators import evaluation as E
from slatewright.operators.hybrids import best_parameters, diversity_filter, popularity_filter, popularity_then_diversity
from slatewright.plans.models import Recommender
from slatewright.plans.prepared import Dataset
from slatewright.session import cut_lineage


@dataclass(frozen=True)
class PopularItems:
    """Items below a quantile of the popularity go, while the slate is long enough."""

    popularity: DataFrame = field(repr=False)
    quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)

    @staticmethod
    def of(log: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> PopularItems:
        return PopularItems(stats.session_popularity(log), tuple(quantiles))

    def sweep(self, slates: DataFrame, k: int, only: float | None = None) -> DataFrame:
        """``param, case_id, rank, item_id``; ``param`` is the quantile."""
        levels = stats.popularity_cutoffs(self.popularity, self.quantiles if only is None else (only,))
        return popularity_filter(slates, self.popularity, levels, k)


@dataclass(frozen=True)
class DiverseItems:
    """Items whose likeness to one kept before is at a quantile of all pairs' likeness or above go."""

    items: DataFrame = field(repr=False)
    quantiles: tuple[float, ...] = (0.9, 0.97)

    def sweep(self, slates: DataFrame, k: int, only: float | None = None) -> DataFrame:
        wanted = self.quantiles if only is None else (only,)
        levels = dict(zip(wanted, stats.similarity_cutoffs(self.items, wanted), strict=True))
        named = F.create_map(*[F.lit(x) for q, level in levels.items() for x in (float(level), float(q))])
        kept = diversity_filter(slates, self.items, list(levels.values()), k)
        return kept.withColumn("param", F.element_at(named, F.col("param")))


@dataclass(frozen=True)
class PopularDiverseItems:
    """Both, one after the other; ``param`` is 1000 times the popularity's quantile and the diversity's."""

    popular: PopularItems
    diverse: DiverseItems

    def sweep(self, slates: DataFrame, k: int, only: float | None = None) -> DataFrame:
        grid = [(p, d) for p in self.popular.quantiles for d in self.diverse.quantiles]
        grid = [x for x in grid if only is None or _grid_point(*x) == only]
        by_pop, by_div = sorted({p for p, _ in grid}), sorted({d for _, d in grid})
        levels = dict(zip(stats.similarity_cutoffs(self.diverse.items, by_div), by_div, strict=True))
        cutoffs = stats.popularity_cutoffs(self.popular.popularity, by_pop)
        kept = popularity_then_diversity(slates, self.popular.popularity, cutoffs, self.diverse.items, list(levels), k)
        named = F.create_map(*[F.lit(float(x)) for pair in levels.items() for x in pair])
        point = F.round(F.col("pop_param") * 1000) + F.element_at(named, F.col("div_param"))
        return kept.select(point.alias("param"), "case_id", "rank", "item_id")


def _grid_point(popular: float, diverse: float) -> float:
    return round(popular * 1000) + diverse


def property_search(models: dict[str, Recommender], data: Dataset, folds: DataFrame, prop, k: int = 20, pool: int = 5,
                    top_ks: Sequence[int] = (10, 20), metrics: Sequence[str] = E.RANKING, n_withheld: int = 1
                    ) -> tuple[DataFrame, tuple[str, float], DataFrame]:
    """(reports ``model, param, fold, top_k, metric, value``, best (model, param), its report on the test sessions).

    ``folds`` holds ``session_id, fold, role`` over ``data.train``. Candidates recommend ``pool`` times ``k`` items, of
    which the property keeps ``k``. The best mean NDCG at ``k`` wins; ties go to the smaller parameter and model name.
    """
    reports = None
    for fold in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        labelled = splitting.with_roles(data.train, folds.where(F.col("fold") == fold).drop("fold"))
        train = cut_lineage(labelled.where("role = 'train'").drop("role"))
        held = cut_lineage(splitting.drop_untrained(train, labelled.where("role = 'validation'").drop("role")))
        prompts, truths = cases.prompts(held, n_withheld), cases.ground_truths(held, n_withheld)
        for name, model in models.items():
            slates = cut_lineage(model.fit(train, data.items).recommend(prompts, k * pool))
            swept = prop.sweep(slates, k).withColumn("model", F.lit(name))
            report = E.evaluate(swept, truths, top_ks, metrics, keys=("model", "param")).withColumn("fold", F.lit(fold))
            reports = report if reports is None else reports.unionByName(report)
    reports = cut_lineage(reports)
    best = best_parameters(reports, top_k=k).orderBy(F.desc("value"), "model").first()
    winner = models[best["model"]].fit(data.train, data.items).recommend(data.prompts, k * pool)
    shown = prop.sweep(winner, k, best["param"]).withColumn("model", F.lit(best["model"]))
    return reports, (best["model"], best["param"]), E.evaluate(shown, data.truths, top_ks, metrics, keys=("model", "param"))
