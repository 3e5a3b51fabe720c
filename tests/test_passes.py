"""What an analysis reads: its source once, and a training table whose tasks carry no lineage."""

import contextlib
import io

from pyspark.sql import functions as F

from tribunal.functions import rules
from tribunal.operators.candidates import Profile
from tribunal.operators.training import training_table
from tribunal.plans.analysis import analyze

TINY = Profile(trees=2, rounds=1, tree_depth=2, forest_depth=2, bins=8)


def test_source_rows_are_derived_once(spark):
    n, seen = 400, spark.sparkContext.accumulator(0)

    @F.udf("double")
    def derived(i):
        seen.add(1)
        return float(i % 37)

    rows = spark.range(n).select(
        "id", derived("id").alias("x"), (F.col("id") % 11).alias("z"), (F.col("id") % 37 > 18).cast("int").alias("y"))
    a = analyze(rows, "y", key="id", profile=TINY)
    assert a.leaderboard.count() == 5
    # One whole pass, and the few rows that show the table has enough.
    assert n <= seen.value <= 2 * n
    a.release()
    assert not a.source.is_cached and not a.table.rows.is_cached


def test_rows_of_a_key_not_asked_for_are_kept_once(spark):
    """Without a key the rows get ids first; every row stays, equal ones too."""
    rows = spark.range(120).select((F.col("id") % 6).cast("double").alias("x"), (F.col("id") % 4).cast("double").alias("w"),
                                   (F.col("id") % 6 > 2).cast("int").alias("y"))
    a = analyze(rows, "y", profile=TINY)
    assert a.table.rows.count() == 120 and a.dataset_info.first()["rows"] == 120
    a.release()


def test_training_rows_carry_no_lineage(spark):
    prepared = spark.range(100).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 5).cast("int").alias("fold"))
    table = training_table(prepared, ["a", "b"], rules.CLASSIFICATION, 100)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        table.rows.explain()
    assert "Scan ExistingRDD" in said.getvalue()
    assert "Exchange" not in said.getvalue() and "Range" not in said.getvalue()
    assert sorted(r["row_id"] for r in table.rows.collect()) == list(range(100))
    assert (table.whole.n_rows, [f.n_rows for f in table.without_fold]) == (100, [80] * 5)
    table.release()
