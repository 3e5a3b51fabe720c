"""Fold metrics from predictions.

The inputs are counted first: (problem, model, fold, side, label, prediction)
for classes.  Each metric is then an aggregate over at most classes² rows per
fold.  Every function takes the grouping columns, so one call serves many
models, folds and problems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tribunal.functions.columns import name


def confusion(predictions: DataFrame, groups: list[str], weight: str | None = None) -> DataFrame:
    """Rows per (groups, label, prediction)."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return predictions.groupBy(*groups, "label", "prediction").agg(n.alias("n"))


def classification_by_fold(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Accuracy and macro F1 per group from a confusion table.

    Macro F1 averages over every class that is a label or a prediction in the
    group; a class never hit scores 0.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"),
                 F.lit(0).cast("long").alias("guessed"), hit.cast("long").alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hits")),
    )
    return (
        counts.select(*groups, F.inline(sides))
        .groupBy(*groups, "class")
        .agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))
        .groupBy(*groups)
        .agg(
            F.try_divide(F.sum("hits"), F.sum("actual")).alias("accuracy"),
            F.avg(2.0 * F.col("hits") / (F.col("actual") + F.col("guessed"))).alias("f1_macro"),
            F.sum("actual").alias("n_rows"),
        )
    )


def regression_by_fold(
    predictions: DataFrame, groups: list[str], weight: str | None = None, centre: float = 0.0
) -> DataFrame:
    """R² and mean absolute error per group, in one aggregate.

    Rows may carry a repeat count in ``weight``; ``centre``, a value near the
    mean label, then keeps the sum of squares well conditioned.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, p = F.col("label"), F.col("prediction")
    if weight is None:
        spread = F.var_pop("label") * F.count(F.lit(1))
    else:
        off = y - F.lit(centre)
        spread = F.sum(w * off * off) - F.sum(w * off) * F.sum(w * off) / F.sum(w)
    return predictions.groupBy(*groups).agg(
        (1.0 - F.try_divide(F.sum(w * (y - p) * (y - p)), spread)).alias("r2"),
        (F.sum(w * F.abs(y - p)) / F.sum(w)).alias("mae"),
        F.sum(w).cast("long").alias("n_rows"),
    )


def _mean_by_side(fold_metrics: DataFrame, keys: list[str], metric: str) -> list[Column]:
    return [
        F.avg(F.when(F.col("side") == side, F.col(metric))).alias(f"_{side}_{metric}")
        for side in ("test", "train")
    ]


def summarise(fold_metrics: DataFrame, keys: list[str], headline: str, other: str) -> DataFrame:
    """Mean over folds of test and train metrics, and the overfit gap.

    ``headline`` is the metric the gap is read from (accuracy or r2).
    """
    gap = F.greatest(F.lit(0.0), F.col(f"_train_{headline}") - F.col(f"_test_{headline}"))
    fields = [
        F.round(f"_{side}_{metric}", 4).alias(f"{side}_{metric}")
        for metric in (headline, other) for side in ("test", "train")
    ]
    return (
        fold_metrics.groupBy(*[name(k) for k in keys])
        .agg(*_mean_by_side(fold_metrics, keys, headline), *_mean_by_side(fold_metrics, keys, other))
        .select(*keys, *fields, F.round(gap, 4).alias("overfit_gap"))
    )
