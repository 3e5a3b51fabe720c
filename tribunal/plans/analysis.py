"""The whole analysis: one table and a target in, tables of decisions out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tribunal.functions import rules
from tribunal.functions.columns import name
from tribunal.operators import detect, explain as X, features as E, profile as P, verdict as V
from tribunal.operators.candidates import PROFILES, Profile, candidates
from tribunal.operators.folds import kfold, stratified_folds
from tribunal.operators.mutual_info import (
    binned_mutual_info, neighbour_mutual_info, neighbour_mutual_info_regression,
)
from tribunal.operators.prepare import (
    Preparation, cast_target, decision_log, encode_target, fit_preparation, with_growth,
)
from tribunal.operators.score import ModelRun, Scorer, class_list
from tribunal.operators.training import (
    TrainingTable, cross_validate, metrics_frame, refit, training_table,
)
from tribunal.session import freeze


@dataclass
class Analysis:
    """Results of every stage; all tables are DataFrames."""

    dataset_info: DataFrame
    detection: DataFrame
    problem_type: str
    preparation: Preparation
    class_codes: DataFrame | None
    selected: list[str]
    feature_report: DataFrame
    ranking: DataFrame
    decision_log: DataFrame
    metrics: DataFrame
    judged: DataFrame
    explanation: X.Explanation | None
    scorer: Scorer
    models: dict[str, object] = field(default_factory=dict)
    distribution: DataFrame | None = None
    statistics: DataFrame | None = None
    sample_values: list = field(default_factory=list)
    table: TrainingTable | None = None
    neighbours: DataFrame | None = None
    source: DataFrame | None = None

    @property
    def run(self) -> ModelRun:
        """Every model that was refitted; all of them after ``keep_all``."""
        return ModelRun(self.scorer, self.models, self.neighbours)

    @property
    def leaderboard(self) -> DataFrame:
        return V.leaderboard(self.judged)

    @property
    def dimension_scores(self) -> DataFrame:
        return V.dimension_scores(self.judged)

    @property
    def rationales(self) -> DataFrame:
        return V.rationales(self.judged)

    @property
    def winner(self) -> DataFrame:
        return V.winners(self.judged)

    def release(self) -> None:
        """Free the persisted training table and the persisted source rows."""
        if self.table is not None:
            self.table.release()
        if self.source is not None:
            self.source.unpersist()


def with_row_id(df: DataFrame, key: str | None, block: int = 100_000) -> tuple[DataFrame, str]:
    """The key column, or a digest of the row with the number of its occurrence.

    The ids depend on the rows alone, not on files or partitions.  Equal rows
    are counted first and written out again in blocks, so a row that makes up
    a third of the table is spread over tasks.
    """
    if key is not None:
        return df, key
    cells = [name(c) for c in df.columns]
    plain = [name(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    counted = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("_rows"))
    digest = F.concat_ws("-", F.hex(F.xxhash64(*plain)), F.md5(F.to_json(F.struct(*cells)))) if plain else F.md5(
        F.to_json(F.struct(*cells)))
    blocks = counted.withColumn("_digest", digest).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / block))))
    dealt = blocks.repartition("_digest", "_block")
    within = F.sequence(F.col("_block") * block, F.least((F.col("_block") + 1) * block, F.col("_rows")) - 1)
    numbered = dealt.select(*cells, "_digest", F.explode(within).alias("_occurrence"))
    return freeze(numbered.select(
        *cells, F.concat_ws("-", "_digest", "_occurrence").alias("row_id"))), "row_id"


def prepared_rows(
    df: DataFrame, preparation: Preparation, key: str
) -> tuple[DataFrame, DataFrame | None]:
    """(row_id, label, <features>) and the class code table."""
    target = preparation.target
    if preparation.problem_type == rules.CLASSIFICATION:
        labelled, codes = encode_target(df, target, "_label")
    else:
        labelled, codes = cast_target(df, target, "_label"), None
    prepared = preparation.apply(labelled, [key, "_label"])
    if key != "row_id":
        prepared = prepared.withColumnRenamed(key, "row_id")
    return prepared.withColumnRenamed("_label", "label"), codes


def mutual_information(
    prepared: DataFrame, selected: list[str], preparation: Preparation, estimator: str = "binned"
) -> DataFrame:
    """Score of every selected feature against the label."""
    classify = preparation.problem_type == rules.CLASSIFICATION
    if estimator == "neighbour":
        estimate = neighbour_mutual_info if classify else neighbour_mutual_info_regression
        return estimate(prepared, selected, "label", "row_id")
    discrete = [f for f in selected if f in preparation.categorical]
    return binned_mutual_info(prepared, selected, "label", discrete, classify)


def analyze(
    df: DataFrame, target: str, features: list[str] | None = None, key: str | None = None,
    profile: str | Profile = "full", keep_all: bool = False, estimator: str = "binned",
    sample_rows: int | None = None, clock: Callable[[], float] = time.perf_counter, growth: bool = False,
) -> Analysis:
    """Detect, prepare, select, train, judge and explain.

    ``key`` names a column that identifies rows; it is never a feature unless
    listed in ``features``.  ``profile`` sizes the tree ensembles, ``keep_all``
    refits every candidate rather than the winner only, ``sample_rows`` limits
    the rows a Shapley explanation reads (all by default).  ``growth`` reads
    the table once more, so that the scorer can also prepare each new row as if
    it were part of the table (``unseen="refit"``).
    """
    spark = df.sparkSession
    size = profile if isinstance(profile, Profile) else PROFILES[profile]
    P.require_target(df, target)
    P.require_min_rows(df)
    log: list[tuple[str, list[dict]]] = []
    chosen = P.select_features(P.drop_null_target(df, target), target, features, [] if key is None else [key])
    chosen, row_id = with_row_id(chosen, key)
    # Every stage below reads these rows; without a copy each would derive them from the files again.
    chosen = source = chosen.persist(StorageLevel.MEMORY_AND_DISK)
    exclude = [] if features is not None and row_id in features else [row_id]

    detection = detect.detect_problem(chosen, target)
    decided = detection.first()
    problem_type, n_rows = decided["problem_type"], decided["n_rows"]
    if n_rows < rules.MIN_ROWS:
        log.append(("validation", [{"step": "Row Count", "rule": f"Fewer than {rules.MIN_ROWS} rows have a target.",
                                    "rows": n_rows}]))
    preparation = fit_preparation(chosen, target, problem_type, exclude)
    if growth:
        preparation = with_growth(chosen, preparation)
    if row_id in preparation.features:
        chosen = chosen.withColumn("_row_id", name(row_id))
        row_id = "_row_id"
    prepared, codes = prepared_rows(chosen, preparation, row_id)
    n_classes, labels = class_list(codes)
    steps = list(preparation.steps)
    if codes is not None:
        # A long list of labels stays in its table.
        steps.append({"step": "Target Classes", "rule": "Labels sorted as text are numbered from 0.",
                      "classes": n_classes, "label_classes": dict(enumerate(labels))})
    log.append(("preprocessing", steps))

    selected, feature_steps, report = E.select(prepared, preparation.features)
    P.require_features(selected)
    ranking = E.rank_features(mutual_information(prepared, selected, preparation, estimator)).persist()
    ranked = [r.asDict() for r in ranking.orderBy("rank").collect()]
    feature_steps.append({"step": "Mutual Information Ranking",
                          "rule": "Score each feature by mutual information with the target.",
                          "estimator": estimator, "importance_ranking": ranked})
    log.append(("feature_analysis", feature_steps))

    if problem_type == rules.CLASSIFICATION:
        folded = stratified_folds(prepared, "row_id", "label", n_rows)
    else:
        folded = kfold(prepared, "row_id")
    table = training_table(folded, selected, problem_type, n_rows)
    pool = candidates(problem_type, size)
    metrics = metrics_frame(spark, cross_validate(table, pool, clock=clock))
    judged = V.judge(metrics, problem_type)
    best = V.winners(judged).first()["winner"]

    succeeded = [r["model_name"] for r in metrics.filter("status = 'success'").collect()]
    wanted = succeeded if keep_all else [best] if best else []
    models = {c.name: refit(table, c) for c in pool if c.name in wanted}
    explanation = X.explain(models[best], best, table.rows, selected, sample_rows) if best else None
    neighbours = None
    if any(m is None for m in models.values()):
        neighbours = prepared.select("row_id", "label", *[name(f) for f in selected])
    train_rows = neighbours if best and models[best] is None else None
    scorer = Scorer(best, problem_type, preparation, selected, labels, models.get(best), train_rows, codes, n_classes)

    decisions = None
    for phase, phase_steps in log:
        part = decision_log(spark, phase, phase_steps)
        decisions = part if decisions is None else decisions.unionByName(part)
    classify = problem_type == rules.CLASSIFICATION
    return Analysis(
        dataset_info=P.dataset_info(chosen.drop("_row_id") if exclude == [] else chosen.drop(*exclude), target),
        detection=detection, problem_type=problem_type, preparation=preparation, class_codes=codes,
        selected=selected, feature_report=report, ranking=ranking, decision_log=decisions, metrics=metrics,
        judged=judged, explanation=explanation, scorer=scorer, models=models,
        distribution=detect.class_distribution(chosen, target) if classify else None,
        statistics=None if classify else detect.target_stats(chosen, target),
        sample_values=detect.sample_values(chosen, target, row_id), table=table, neighbours=neighbours,
        source=source)
