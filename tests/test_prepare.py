import math

import pytest
from pyspark.sql import functions as F

from tribunal.functions import rules
from tribunal.operators import detect, features as E, prepare as R, profile as P


def _problem(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"t {kind}")
    return detect.detect_problem(df, "t").first()


def test_ratio_exactly_at_the_limit_is_classification(spark):
    at = _problem(spark, [i % 5 for i in range(100)], "int")
    assert (at["problem_type"], at["confidence"]) == ("classification", "medium")
    assert at["rule_triggered"] == "Rule 3: Low cardinality (5 unique values, 5.0% ratio)"
    beyond = _problem(spark, [i % 5 for i in range(99)], "int")
    assert beyond["problem_type"] == "regression"
    assert _problem(spark, [i % 21 for i in range(1000)], "int")["problem_type"] == "regression"
    assert _problem(spark, [i % 20 for i in range(1000)], "int")["problem_type"] == "classification"


def test_nulls_and_nan_do_not_count(spark):
    row = _problem(spark, [1.0, 2.0, None, float("nan")], "double")
    assert (row["unique_count"], row["n_rows"], row["confidence"]) == (2, 2, "high")


def test_text_and_boolean_targets(spark):
    assert _problem(spark, [str(i) for i in range(50)], "string")["problem_type"] == "classification"
    assert _problem(spark, [True, False], "boolean")["rule_triggered"].startswith("Rule 1")


def test_sample_values_beyond_the_head(spark):
    rows = [(i, 0 if i < 900 else i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v int")
    assert detect.sample_values(df, "v", "k") == [0, 4, 5, 6, 1]
    assert detect.sample_values(df.filter("k < 900"), "v", "k") == [0]


def test_target_stats_of_a_constant(spark):
    assert detect.target_stats(spark.createDataFrame([(1.0,)] * 5, "t double"), "t").first()["skew"] is None


def test_missing_ratio_exactly_half_is_kept(spark):
    df = spark.createDataFrame([(1.0, None, 1), (2.0, None, 2), (None, 1.0, 3), (None, None, 4)],
                               "half double, most double, y int")
    p = R.fit_preparation(df, "y", rules.REGRESSION)
    assert p.features == ["half"]
    assert [s["dropped"] for s in p.steps if s["step"] == "Mostly Missing Columns"] == [["most"]]


@pytest.mark.parametrize("n,kept", [(20, True), (21, False)])
@pytest.mark.parametrize("nulls", [0, 3])
def test_cardinality_limit_ignores_nulls(spark, n, kept, nulls):
    values = [f"v{i % n:02d}" for i in range(4 * n)] + [None] * nulls
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "c string, y int")
    p = R.fit_preparation(df, "y", rules.REGRESSION)
    assert (p.features == ["c"]) is kept
    if kept and nulls:
        assert "nan" in p.categorical["c"].categories and len(p.categorical["c"].categories) == n + 1


def test_boolean_with_null_sorts_before_nan(spark):
    df = spark.createDataFrame([(True, 1), (False, 2), (None, 3)], "b boolean, y int")
    p = R.fit_preparation(df, "y", rules.REGRESSION)
    assert p.categorical["b"].categories == ["False", "True", "nan"]
    assert [r["b"] for r in p.apply(df, ["y"]).orderBy("y").collect()] == [1.0, 0.0, 2.0]


def test_imputed_moments_match_the_filled_column(spark):
    values = [1.0, 2.0, 10.0, None, float("nan"), 4.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, y int")
    p = R.fit_preparation(df, "y", rules.REGRESSION).numeric["x"]
    filled = [1.0, 2.0, 10.0, 3.0, 3.0, 4.0]
    mean = sum(filled) / 6
    assert (p.median, p.missing) == (3.0, 2)
    assert p.mean == pytest.approx(mean)
    assert p.std == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in filled) / 6))


def test_constant_column_scales_to_zero_and_is_filtered(spark):
    df = spark.createDataFrame([(7.0, float(i), i % 2) for i in range(30)], "c double, x double, y int")
    p = R.fit_preparation(df, "y", rules.CLASSIFICATION)
    prepared = p.apply(df, ["y"])
    assert prepared.agg(F.max(F.abs("c"))).first()[0] == 0.0
    kept, steps, _ = E.select(prepared, p.features)
    assert kept == ["x"] and steps[0]["dropped_features"] == ["c"]


def test_unsupported_types_are_dropped_and_logged(spark):
    df = spark.createDataFrame([([1.0], 1.0, i) for i in range(5)], "v array<double>, x double, y int")
    p = R.fit_preparation(df, "y", rules.REGRESSION)
    assert p.features == ["x"] and p.steps[1]["dropped"] == ["v"]


def test_numeric_labels_sort_as_text(spark):
    df = spark.createDataFrame([(2,), (10,), (2,)], "y int")
    assert {r["label"]: r["code"] for r in R.class_codes(df, "y").collect()} == {"10": 0, "2": 1}


def test_encode_then_decode_is_identity(spark):
    from tribunal.operators.score import decode_label
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "y string")
    coded, codes = R.encode_target(df, "y")
    labels = [r["label"] for r in codes.orderBy("code").collect()]
    assert all(r["y"] == r["d"] for r in coded.select("y", decode_label(F.col("label"), labels).alias("d")).collect())


def test_correlation_exactly_at_the_limit_is_kept(spark):
    pairs = spark.createDataFrame([(0, 1, "a", "b", 0.9), (0, 2, "a", "c", 0.95), (2, 3, "c", "d", 0.96)],
                                  "i long, j long, feature_i string, feature_j string, corr double")
    dropped = {r["dropped"]: r["correlated_with"] for r in E.correlation_prune(pairs).collect()}
    # d is dropped because of c although c is dropped itself
    assert dropped == {"c": ["a"], "d": ["c"]}


def test_checks(spark):
    df = spark.createDataFrame([(i, i) for i in range(19)], "x int, y int")
    with pytest.raises(P.AnalysisError):
        P.require_min_rows(df)
    P.require_min_rows(df.union(df.limit(1)))
    with pytest.raises(P.AnalysisError):
        P.require_target(df, "z")
    with pytest.raises(P.AnalysisError):
        P.select_features(df, "y", ["y", "nope"])
    with pytest.raises(P.AnalysisError):
        P.require_features([])


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(float(i), "a", i % 2) for i in range(30)], "`a.b c` double, `d``e` string, y int")
    p = R.fit_preparation(df, "y", rules.CLASSIFICATION)
    assert p.features == ["a.b c", "d`e"]
    assert p.apply(df, ["y"]).count() == 30
