"""The fixed candidates, in the order that settles ties."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)

from tribunal.functions import rules
from tribunal.operators.boosting import SoftmaxBoosting
from tribunal.operators.deep_forest import DeepForest

#: Depth to which the upper part of a forest without a limit is grown.
UPPER_DEPTH = 12


@dataclass(frozen=True)
class Profile:
    """Size knobs of the tree ensembles.

    ``forest_depth=None`` grows forests until nothing is left to split; such a
    model can get as large as the table, so the default stops at a depth.
    """

    trees: int = 100
    rounds: int = 100
    tree_depth: int = 8
    forest_depth: int | None = 12
    boosting_depth: int = 3
    bins: int = 128


PROFILES = {
    "full": Profile(),
    "deep": Profile(forest_depth=None),
    "fast": Profile(trees=10, rounds=10, tree_depth=8, forest_depth=8, bins=64),
}


@dataclass(frozen=True)
class TrainingFacts:
    """What an estimator must know about the rows it will be fitted on."""

    n_rows: int
    label_std: float
    n_classes: int


@dataclass(frozen=True)
class Candidate:
    name: str
    ordinal: int
    estimator: Callable[[TrainingFacts], Estimator] | None   # None: neighbours


def ridge(facts: TrainingFacts, alpha: float = 1.0) -> LinearRegression:
    """Penalised least squares with penalty ``alpha`` on the squared weights.

    Spark scales the penalty by rows and by the label's deviation.
    """
    return LinearRegression(
        regParam=alpha * facts.label_std / max(facts.n_rows, 1), elasticNetParam=0.0,
        standardization=False, solver="normal")


def logistic(facts: TrainingFacts) -> LogisticRegression:
    """L2-penalised logistic regression with C = 1."""
    return LogisticRegression(
        regParam=1.0 / max(facts.n_rows, 1), elasticNetParam=0.0, standardization=False, maxIter=1000)


def forest(kind: type, p: Profile, tried: str, n_classes: int = 0) -> Estimator | DeepForest:
    """A forest of the profile's depth, or one that is finished below ``UPPER_DEPTH``."""
    top = kind(numTrees=p.trees, maxDepth=p.forest_depth or UPPER_DEPTH, maxBins=p.bins, featureSubsetStrategy=tried, seed=rules.SEED)
    return top if p.forest_depth else DeepForest(top, n_classes, tried, rules.SEED)


def candidates(problem_type: str, profile: Profile) -> list[Candidate]:
    p, seed = profile, rules.SEED
    if problem_type == rules.CLASSIFICATION:
        def boosted(facts: TrainingFacts) -> Estimator:
            if facts.n_classes > 2:
                return SoftmaxBoosting(facts.n_classes, p.rounds, p.boosting_depth, 0.1, p.bins)
            return GBTClassifier(maxIter=p.rounds, maxDepth=p.boosting_depth, stepSize=0.1, seed=seed, maxBins=p.bins)

        builders = [
            (rules.LOGISTIC, logistic),
            (rules.TREE, lambda f: DecisionTreeClassifier(maxDepth=p.tree_depth, maxBins=p.bins, seed=seed)),
            (rules.FOREST, lambda f: forest(RandomForestClassifier, p, "sqrt", f.n_classes)),
            (rules.BOOSTING, boosted),
            (rules.KNN, None),
        ]
    else:
        builders = [
            (rules.RIDGE, ridge),
            (rules.TREE, lambda f: DecisionTreeRegressor(maxDepth=p.tree_depth, maxBins=p.bins, seed=seed)),
            (rules.FOREST, lambda f: forest(RandomForestRegressor, p, "all")),
            (rules.BOOSTING, lambda f: GBTRegressor(
                maxIter=p.rounds, maxDepth=p.boosting_depth, stepSize=0.1, seed=seed, maxBins=p.bins)),
            (rules.KNN, None),
        ]
    return [Candidate(title, i, build) for i, (title, build) in enumerate(builders)]
