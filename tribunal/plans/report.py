"""The contents of the analysis report, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tribunal.functions import rules
from tribunal.operators.explain import importance_view
from tribunal.operators.score import overfit_band
from tribunal.plans.analysis import Analysis


def cover(a: Analysis, spark: SparkSession) -> DataFrame:
    """One row: data set, target, problem, rule, winner and score of 100."""
    return a.dataset_info.select("rows", "columns", "target_column").join(
        a.detection.select(F.col("target").alias("target_column"), "problem_type", "rule_triggered"), "target_column"
    ).join(
        a.winner.select(F.lit(a.preparation.target).alias("target_column"), "winner",
                        F.round(F.col("winner_score") * 100, 2).alias("composite_of_100")), "target_column")


def leaderboard_table(a: Analysis) -> DataFrame:
    """Ranked models with the headline metrics; gate failures show no metrics."""
    shown = ["test_accuracy", "test_f1_macro"] if a.problem_type == rules.CLASSIFICATION else ["test_r2", "test_mae"]
    judged = F.col("status") == "evaluated"
    return a.judged.select(
        "rank", "model_name", F.round(F.col("composite_score") * 100, 1).alias("score_of_100"),
        *[F.when(judged, F.col(c)).alias(c) for c in shown],
        F.when(judged, F.round(F.col("overfit_gap") * 100, 1)).alias("overfit_percent"),
        F.when(judged, overfit_band(F.col("overfit_gap"))).alias("overfit_band"), "verdict",
    ).orderBy("rank")


def winner_rubric(a: Analysis) -> DataFrame:
    """The winner's dimensions in points, with the running total."""
    first = a.judged.filter(F.col("verdict") == "SELECTED").select("model_name")
    return (
        a.dimension_scores.join(first, "model_name", "left_semi")
        .select("dimension_ordinal", "dimension", F.round(F.col("score") * 100, 1).alias("score_percent"), "weight",
                F.round(F.col("contribution") * 100, 2).alias("points"), "explanation")
        .orderBy("dimension_ordinal")
    )


def feature_summary(a: Analysis) -> DataFrame:
    """Original, selected and removed counts with the names."""
    chosen = F.col("status") == "selected"
    return a.feature_report.agg(
        F.count(F.lit(1)).alias("original"), F.count_if(chosen).alias("selected"),
        F.count_if(~chosen).alias("removed"),
        F.array_sort(F.collect_list(F.when(chosen, F.struct("ordinal", "feature"))))["feature"].alias("selected_features"),
        F.array_sort(F.collect_list(F.when(~chosen, F.struct("ordinal", "feature"))))["feature"].alias("removed_features"),
    )


def importance_table(a: Analysis, n: int = rules.REPORT_FEATURES) -> DataFrame:
    shap = a.explanation.shap if a.explanation else None
    native = a.explanation.importance if a.explanation else None
    return importance_view(shap, native, a.ranking, n)


def report_tables(a: Analysis, spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "cover": cover(a, spark),
        "dataset_summary": a.dataset_info,
        "leaderboard": leaderboard_table(a),
        "winner_rubric": winner_rubric(a),
        "feature_summary": feature_summary(a),
        "importance": importance_table(a),
    }
