import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tribunal import analyze
from tribunal.functions import rules
from tribunal.operators import prepare as R, score as S
from tribunal.operators.boosting import SoftmaxModel
from tribunal.operators.candidates import Profile
from tribunal.plans import fixtures as T
from tribunal.plans.analysis import prepared_rows
from tribunal.sources.writers import load_run, save_run

TINY = Profile(trees=3, rounds=3, tree_depth=4, forest_depth=4, bins=32)


@pytest.fixture(scope="module")
def roles(spark, folder):
    a = analyze(T.turn_roles(spark, folder), "role", key="turn_id", profile=TINY, keep_all=True)
    yield a
    a.release()


def test_every_model_is_saved_and_scores_as_before(spark, folder, roles, tmp_path):
    save_run(roles.run, spark, str(tmp_path / "run"))
    run = load_run(spark, str(tmp_path / "run"))
    assert list(run.models) == list(roles.models) and isinstance(run.models[rules.BOOSTING], SoftmaxModel)
    rows = T.turn_roles(spark, folder).drop("role")
    before, after = (r.score_all(rows, "turn_id") for r in (roles.run, run))
    assert before.exceptAll(after).count() == 0 and after.count() == 5 * 87
    # each model alone gives what all give together
    for title in run.models:
        alone = run.scorer(title).score(rows, "turn_id").select("turn_id", "prediction", "prediction_label", F.round("confidence", 9).alias("c"))
        together = after.filter(F.col("model_name") == title).select("turn_id", "prediction", "prediction_label", F.round("confidence", 9).alias("c"))
        assert alone.exceptAll(together).count() == 0, title
    plan = run.score_all(rows, "turn_id").filter(F.col("model_name") != rules.KNN)
    assert plan.count() == 4 * 87


def test_labels_of_many_classes_come_from_the_table(spark, folder, roles):
    from dataclasses import replace
    rows = T.turn_roles(spark, folder).drop("role")
    listed = roles.run.score_all(rows, "turn_id")
    run = replace(roles.run, shared=replace(roles.scorer, labels=[]))
    assert run.score_all(rows, "turn_id").exceptAll(listed).count() == 0


def test_an_unfinished_run_has_no_manifest(spark, roles, tmp_path):
    with pytest.raises(Exception):
        load_run(spark, str(tmp_path / "none"))


def test_rows_of_one_file_are_scored_by_all_cores(spark):
    """One partition in, the trees are applied by several tasks, each row once; a null key stays a row."""
    df = spark.range(400).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), (F.col("id") % 9).cast("double").alias("x"),
                                 (F.col("id") % 9 * 2.0).alias("y")).coalesce(1)
    preparation = R.fit_preparation(df, "y", rules.REGRESSION, ["id"])
    prepared, _ = prepared_rows(df, preparation, "id")
    model = DecisionTreeRegressor(maxDepth=4, seed=1).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(prepared))
    run = S.ModelRun(S.Scorer(rules.TREE, rules.REGRESSION, preparation, ["x"], [], model), {rules.TREE: model})
    scored = run.score_all(df, "id").withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in scored}) == spark.sparkContext.defaultParallelism
    assert sorted((r["id"] is None, r["id"] or 0) for r in scored) == sorted((i == 7, 0 if i == 7 else i) for i in range(400))
    assert all(r["prediction"] == r["id"] % 9 * 2 for r in scored if r["id"] is not None)
