"""Writers: the result bundle of an analysis, and a scorer that can be reloaded."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.ml.classification import (
    DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel, OneVsRestModel,
    RandomForestClassificationModel,
)
from pyspark.ml.regression import (
    DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tribunal.operators.boosting import SoftmaxModel
from tribunal.operators.deep_forest import DeepForestModel
from tribunal.operators.prepare import CategoryParams, NumericParams, Preparation
from tribunal.operators.refit import GrowthParams
from tribunal.operators.score import ModelRun, Scorer
from tribunal.operators.verdict import rule_catalogue
from tribunal.plans.analysis import Analysis
from tribunal.plans.report import report_tables

_MODELS = {m.__name__: m for m in (
    DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegressionModel, OneVsRestModel,
    RandomForestClassificationModel, DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel,
    RandomForestRegressionModel, DeepForestModel,
)}


def analysis_tables(a: Analysis, spark: SparkSession) -> dict[str, DataFrame]:
    """Every result table by name."""
    tables = {
        "dataset_info": a.dataset_info, "problem_detection": a.detection, "decision_log": a.decision_log,
        "preparation_params": a.preparation.params_frame(spark),
        "preparation_categories": a.preparation.categories_frame(spark),
        "feature_report": a.feature_report, "mutual_information": a.ranking, "metrics": a.metrics,
        "verdict_leaderboard": a.leaderboard, "dimension_scores": a.dimension_scores, "rationales": a.rationales,
        "winner": a.winner, "rules": rule_catalogue(spark, a.problem_type),
        **{f"report_{k}": v for k, v in report_tables(a, spark).items()},
    }
    optional = {"class_distribution": a.distribution, "target_stats": a.statistics, "label_classes": a.class_codes}
    if a.explanation is not None:
        optional.update(explanation=a.explanation.summary(spark), shap=a.explanation.shap,
                        importance=a.explanation.importance, top_features=a.explanation.top_features())
    tables.update({k: v for k, v in optional.items() if v is not None})
    return tables


def write_analysis(a: Analysis, spark: SparkSession, folder: str, fmt: str = "json") -> list[str]:
    """Write every result table below ``folder`` as JSON or Parquet."""
    tables = analysis_tables(a, spark)
    for title, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{title}")
    return sorted(tables)


def save_scorer(scorer: Scorer, spark: SparkSession, folder: str) -> None:
    """Persist the winner with the parameters needed to score new rows."""
    p = scorer.preparation
    facts = {
        "model_name": scorer.model_name, "problem_type": scorer.problem_type, "selected": scorer.selected,
        "labels": scorer.labels, "target": p.target, "features": p.features, "original": p.original,
        "n_rows": p.n_rows, "steps": p.steps,
        "model_class": None if scorer.model is None else type(scorer.model).__name__,
        "neighbours": scorer.train_rows is not None, "classes": scorer.n_classes, "coded": scorer.codes is not None,
        "numeric": {f: [v.median, v.mean, v.std, v.missing] for f, v in p.numeric.items()},
        "categorical": {f: [v.categories, v.mode, v.n_values] for f, v in p.categorical.items()},
        "growth": {f: [v.present, v.mean, v.variance, v.least, v.greatest, v.middle] for f, v in p.growth.items()},
        "types": {f: t.json() for f, t in p.types.items()},
    }
    spark.createDataFrame([(json.dumps(facts, ensure_ascii=False),)], "value string").write.mode("overwrite").text(
        f"{folder}/facts")
    _save_model(spark, scorer.model, f"{folder}/model")
    if scorer.train_rows is not None:
        scorer.train_rows.write.mode("overwrite").parquet(f"{folder}/rows")
    if scorer.codes is not None:
        scorer.codes.write.mode("overwrite").parquet(f"{folder}/codes")


def _save_model(spark: SparkSession, model, path: str) -> None:
    if isinstance(model, SoftmaxModel):
        model.save(spark, path)
    elif model is not None:
        model.write().overwrite().save(path)


def _load_model(spark: SparkSession, kind: str | None, path: str):
    if kind == SoftmaxModel.__name__:
        return SoftmaxModel.load(spark, path)
    return _MODELS[kind].load(path) if kind else None


def load_scorer(spark: SparkSession, folder: str) -> Scorer:
    facts = json.loads(spark.read.text(f"{folder}/facts").first()["value"])
    types = {f: T._parse_datatype_json_string(t) for f, t in facts["types"].items()}
    preparation = Preparation(
        facts["target"], facts["problem_type"], facts["features"],
        {f: NumericParams(*v) for f, v in facts["numeric"].items()},
        {f: CategoryParams(*v) for f, v in facts["categorical"].items()},
        types, facts["original"], facts["n_rows"], facts["steps"],
        {f: GrowthParams(*v[:-1], tuple(v[-1])) for f, v in facts.get("growth", {}).items()})
    model = _load_model(spark, facts["model_class"], f"{folder}/model")
    rows = spark.read.parquet(f"{folder}/rows") if facts["neighbours"] else None
    return Scorer(facts["model_name"], facts["problem_type"], preparation, facts["selected"], facts["labels"],
                  model, rows, spark.read.parquet(f"{folder}/codes") if facts["coded"] else None, facts["classes"])


def save_run(run: ModelRun, spark: SparkSession, folder: str) -> None:
    """Persist every model below ``folder``: the shared parts once, one folder per model, and a manifest.

    The manifest is written last, so a folder without one is not a finished run.
    """
    save_scorer(replace(run.shared, model=None, train_rows=None), spark, f"{folder}/shared")
    if run.neighbours is not None:
        run.neighbours.write.mode("overwrite").parquet(f"{folder}/neighbours")
    listed = []
    for n, (title, model) in enumerate(run.models.items()):
        _save_model(spark, model, f"{folder}/models/{n}")
        listed.append((n, title, None if model is None else type(model).__name__, title == run.shared.model_name))
    spark.createDataFrame(listed, "place int, model_name string, model_class string, winner boolean").write.mode(
        "overwrite").json(f"{folder}/manifest")


def load_run(spark: SparkSession, folder: str) -> ModelRun:
    """What ``save_run`` has written."""
    listed = spark.read.schema("place int, model_name string, model_class string, winner boolean").json(
        f"{folder}/manifest").orderBy("place").collect()
    models = {r["model_name"]: _load_model(spark, r["model_class"], f"{folder}/models/{r['place']}") for r in listed}
    shared = load_scorer(spark, f"{folder}/shared")
    neighbours = spark.read.parquet(f"{folder}/neighbours") if None in models.values() else None
    winner = next((r["model_name"] for r in listed if r["winner"]), None)
    if winner:
        shared.model, shared.train_rows = models[winner], neighbours if models[winner] is None else None
    return ModelRun(shared, models, neighbours)
