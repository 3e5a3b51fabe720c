import random

import pytest
from pyspark.sql import Window, functions as F

from tribunal.operators import ordering as O
from tribunal.operators.folds import kfold, stratified_folds


def _values(kind):
    random.seed(7)
    spread = [random.gauss(0, 100) for _ in range(3001)]
    if kind == "spread":
        return spread
    if kind == "hot":        # a third of all rows hold one value
        return spread + [5.0] * 1500
    if kind == "edge":       # the hot value sits just above the median
        return sorted(spread)[:1501] + [1e6] * 1500
    return [float("inf"), float("-inf"), 0.0, 1.0, 2.0]


@pytest.mark.parametrize("kind", ["spread", "hot", "edge", "infinite"])
def test_order_statistics_are_exact(spark, kind):
    values = _values(kind)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    n = len(values)
    ranks = sorted({0, n // 3, (n - 1) // 2, n // 2, n - 1})
    found = O.order_statistics(df, {"x": ranks}, {"x": n}, accuracy=50)
    assert [found["x", r] for r in ranks] == [sorted(values)[r] for r in ranks]


def test_medians_by_narrowing_equal_the_built_in(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 97), float(i)) for i in range(1000)], "a double, b double")
    counts = {"a": 1000, "b": 1000}
    small = O.medians(df, counts)
    monkeypatch.setattr(O, "EXACT_MEDIAN_ROWS", 10)
    assert O.medians(df, counts) == small


def test_spread_row_number_equals_one_window(spark, monkeypatch):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 10 > 1, F.col("id") % 10 == 2))
    order = Window.partitionBy("g").orderBy(F.md5(F.col("id").cast("string")), "id")
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 100)
    rows = O.spread_row_number(df, ["g"], ["id"], "n", 5000).withColumn("w", F.row_number().over(order) - 1)
    assert rows.filter("n <> w").count() == 0 and rows.count() == 5000


def test_sorted_row_number_equals_one_window(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 101).alias("x")).repartition(7)
    order = Window.partitionBy("g").orderBy("x", "id")
    rows = O.sorted_row_number(df, ["g"], ["x", "id"], "n").withColumn("w", F.row_number().over(order) - 1)
    assert rows.filter("n <> w").count() == 0 and rows.count() == 3000


def test_folds_are_balanced_and_stable(spark):
    df = spark.range(1003).withColumn("label", (F.col("id") % 4 == 0).cast("double"))
    folded = stratified_folds(df, "id", "label", 1003, mode="exact")
    sizes = [r["n"] for r in folded.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()]
    by_class = {r["label"]: (r["lo"], r["hi"]) for r in folded.groupBy("label", "fold").agg(
        F.count("*").alias("n")).groupBy("label").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).collect()}
    assert len(sizes) == 10 and all(hi - lo <= 1 for lo, hi in by_class.values())
    again = stratified_folds(df.repartition(13), "id", "label", 1003, mode="exact")
    assert folded.exceptAll(again).count() == 0
    assert kfold(df, "id").exceptAll(kfold(df.repartition(9), "id")).count() == 0


def test_folds_do_not_change_with_the_row_count_given(spark):
    df = spark.range(300).selectExpr("id", "id % 3 = 0 as label")
    small, large = ({r["id"]: r["fold"] for r in stratified_folds(df, "id", "label", n).collect()}
                    for n in (300, 200_000_000))
    for folds in (small, large):
        assert sorted(folds.values()) == sorted(i % 5 for i in range(300))


def test_earlier_sums_go_by_runs_of_parts(spark):
    rows = [(g, p, (p * 7 + len(g or "")) % 11) for g in ("a", "bb", None) for p in range(0, 200, 3)]
    got = O.earlier_sums(spark.createDataFrame(rows, "g string, p long, v long"), ["g"], "p", F.floor(F.col("p") / 16), "v")
    expected = {(g, p): sum(v for h, q, v in rows if h == g and q < p) for g, p, _ in rows}
    assert {(r.g, r.p): r._offset for r in got.collect()} == expected


def test_spread_row_number_with_deep_buckets(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(2000)], "g int, i long")
    deep = O.spread_row_number(df, ["g"], ["i"], "n", O.ROWS_PER_BUCKET * 16 ** 4)
    flat = O.spread_row_number(df, ["g"], ["i"], "n", 1)
    assert sorted(deep.collect()) == sorted(flat.collect())
