import json

import pytest

from tribunal import read_table
from tribunal.operators import detect, profile as P
from tribunal.sources.readers import UnsupportedFormat


@pytest.mark.parametrize("kind", ["csv", "breaks", "json", "parquet"])
def test_rows_and_values_in_file_order(spark, tmp_path, kind):
    values = [f"v{(i * 7) % 13}" for i in range(400)]
    path = str(tmp_path / f"t.{'csv' if kind == 'breaks' else kind}")
    if kind == "parquet":
        spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, n long").coalesce(1).write.parquet(path)
    elif kind == "json":
        (tmp_path / "t.json").write_text("\n".join(json.dumps({"v": v, "n": i}) for i, v in enumerate(values)))
    else:
        note = '"a\nb"' if kind == "breaks" else "x"
        (tmp_path / "t.csv").write_text("v,n,note\n" + "".join(f"{v},{i},{note}\n" for i, v in enumerate(values)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = read_table(spark, path, place="at row")
        assert [r["n"] for r in P.preview(df, [], 9, "at row").collect()] == [str(i) for i in range(9)]
        assert "at row" not in P.preview(df, [], 9, "at row").columns
        shuffled = df.repartition(5)
        assert [r["n"] for r in shuffled.orderBy("`at row`").collect()] == list(range(400))
        assert detect.sample_values(shuffled, "v", "at row") == ["v0", "v7", "v1", "v8", "v2"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_other_json_has_no_place(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    with pytest.raises(UnsupportedFormat):
        read_table(spark, str(tmp_path / "a.json"), place="p")
