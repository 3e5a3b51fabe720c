import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tribunal import load_scorer, save_scorer
from tribunal.functions import rules
from tribunal.operators import prepare as R, score as S
from tribunal.plans.analysis import prepared_rows


def _scorer(spark, n_classes, rows_per_class=2):
    """Class c000k has its rows around x = 10 k."""
    df = spark.range(n_classes * rows_per_class).select(
        "id", (F.floor(F.col("id") / rows_per_class) * 10 + F.col("id") % rows_per_class).cast("double").alias("x"),
        F.format_string("c%06d", F.floor(F.col("id") / rows_per_class)).alias("y"))
    preparation = R.fit_preparation(df, "y", rules.CLASSIFICATION, ["id"])
    prepared, codes = prepared_rows(df, preparation, "id")
    n, labels = S.class_list(codes)
    assert n == n_classes
    return df, S.Scorer(rules.KNN, rules.CLASSIFICATION, preparation, ["x"], labels, None,
                        prepared.select("row_id", "label", "x"), codes, n)


def test_fifty_thousand_classes(spark, tmp_path):
    df, scorer = _scorer(spark, 50_000, 3)
    assert scorer.labels == []                     # no list of labels anywhere
    asked = df.filter("id % 997 = 0")
    scored = scorer.score(asked, "id")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "c049999" not in plan and len(plan) < 100_000
    rows = {r["id"]: r for r in scored.collect()}
    assert len(rows) == asked.count()
    for r in asked.collect():
        got = rows[r["id"]]
        assert got["prediction_label"] == r["y"] and got["confidence"] == 0.6
        assert got["class_probabilities_labeled"][r["y"]] == 0.6 and 2 <= len(got["class_probabilities"]) <= 3
        assert sum(got["class_probabilities"].values()) == pytest.approx(1.0)
    save_scorer(scorer, spark, str(tmp_path / "s"))
    again = load_scorer(spark, str(tmp_path / "s"))
    assert again.n_classes == 50_000 and again.labels == []
    view = ["id", "prediction_label", "confidence"]
    assert again.score(asked, "id").select(view).exceptAll(scored.select(view)).count() == 0


@pytest.mark.parametrize("broadcast", [10_000, 5])
def test_dense_and_sparse_ways_agree(spark, monkeypatch, broadcast):
    monkeypatch.setattr(S, "BROADCAST_CLASSES", broadcast)
    df, scorer = _scorer(spark, 30, 4)
    dense = {r["id"]: r for r in scorer.score(df, "id").collect()}
    scorer.labels = []
    for r in scorer.score(df, "id").collect():
        d = dense[r["id"]]
        for c in ("prediction", "prediction_label", "confidence", "confidence_band"):
            assert r[c] == d[c], c
        for c in ("class_probabilities", "class_probabilities_labeled"):
            assert r[c] == {k: v for k, v in d[c].items() if v}


def test_sparse_entries_of_a_model(spark):
    df, scorer = _scorer(spark, 12, 5)
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(scorer.train_rows)
    scorer.model = LogisticRegression(maxIter=20, regParam=1e-3).fit(rows)
    scorer.labels = []
    scored = scorer.score(df, "id").collect()
    for r in scored:
        entries = r["class_probabilities"]
        assert entries[str(int(r["prediction"]))] == pytest.approx(r["confidence"], abs=1e-4)
        assert all(v > 0 for v in entries.values()) and sum(entries.values()) == pytest.approx(1, abs=2e-3)


def test_unknown_code_is_its_own_label(spark):
    codes = spark.createDataFrame([("a", 0), ("b", 1)], "label string, code long")
    rows = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 7.0), (4, None)], "id long, p double")
    for most in (2, 1):
        got = S.with_labels(rows, "p", codes, most * 10_000, "label", "id").orderBy("id").collect()
        assert [r["label"] for r in got] == ["a", "b", "7", None]


def test_copies_of_labels_do_not_multiply_a_long_table(spark, monkeypatch):
    assert S.label_copies(20_000) == S.LABEL_COPIES
    assert S.label_copies(900_000) == S.label_copies(5_000_000) == 1
    monkeypatch.setattr(S, "COPIED_LABELS", 60_000)
    n, asked, copies = 20_000, [], S.label_copies

    def seen(n_classes):
        asked.append((n_classes, copies(n_classes)))
        return asked[-1][1]

    monkeypatch.setattr(S, "label_copies", seen)
    codes = spark.range(n).select(F.format_string("c%05d", "id").alias("label"), F.col("id").alias("code"))
    # Every second row is of one class, some of a class that the table lacks or of none.
    code = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 9 == 0, n + 1).when(F.col("id") % 11 != 0, F.col("id"))
    rows = spark.range(6_000).select("id", code.cast("double").alias("p"))
    named = S.with_labels(rows, "p", codes, n, "label", "id")
    assert asked == [(n, 3)]
    got = {r["id"]: r["label"] for r in named.collect()}
    assert got == {i: "c00007" if i % 2 == 0 else str(n + 1) if i % 9 == 0 else f"c{i:05d}" if i % 11 else None for i in range(6_000)}
