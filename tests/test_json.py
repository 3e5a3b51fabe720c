import json
import random

import pytest
from pyspark.sql import functions as F

from tribunal import read_table
from tribunal.sources.json_columns import write_columns


def test_columns_keep_their_types_and_order(spark, tmp_path):
    path = tmp_path / "c.json"
    columns = {"z": {"10": 1, "9": 2, "x": None}, "text": {"10": "01", "9": "7", "x": "é\n"}, "real": {"10": 1, "9": 2.5, "x": 1e3},
               "flag": {"10": True, "9": None, "x": False}, "mixed": {"10": 1, "9": "b", "x": [1, {"k": 2}]},
               "none": {"10": None, "9": None, "x": None}}
    path.write_text(json.dumps(columns, ensure_ascii=False))
    df = read_table(spark, str(path))
    assert df.dtypes == [("z", "bigint"), ("text", "string"), ("real", "double"), ("flag", "boolean"), ("mixed", "string"), ("none", "double")]
    rows = {r["text"]: tuple(r) for r in df.collect()}
    assert rows["01"] == (1, "01", 1.0, True, "1", None) and rows["7"] == (2, "7", 2.5, None, "b", None)
    assert rows["é\n"][0] is None and json.loads(rows["é\n"][4]) == [1, {"k": 2}]
    # row keys in their order: numbers first as numbers
    assert [r["z"] for r in df.collect()][-2:] == [2, 1]


def test_many_row_keys_make_no_larger_plan(spark, tmp_path):
    plans = []
    for n in (10, 100_000):
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps({"a": {str(i): i for i in range(n)}, "b": {str(i): f"t{i}" for i in range(n)}}, indent=1))
        df = read_table(spark, str(path))
        plans.append(len(df._jdf.queryExecution().analyzed().toString()))
        assert df.count() == n and df.filter("b = concat('t', a)").count() == n
    assert plans[1] < plans[0] + 50


def test_objects_that_are_no_columns(spark, tmp_path):
    for n, value in enumerate([{"a": {"x": 1}, "b": {"y": 2}}, {"a": {"x": 1}, "b": 3}, {"a": {}, "b": {}}]):
        path = tmp_path / f"r{n}.json"
        path.write_text(json.dumps(value))
        assert read_table(spark, str(path)).count() == 1


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", [48, 200, 1 << 20])
def test_columns_cut_anywhere(spark, tmp_path, split, indent):
    """Cells with commas, quotes and brackets, in blocks smaller and larger than a cell."""
    r = random.Random(split)
    text = lambda: "".join(r.choice(['a', ',', '"', '\\', '{', ']', '\n', ' ', 'é,', '}}']) for _ in range(r.randint(0, 15)))
    keys = [f"{i},\"" for i in range(40)]
    columns = {'a,"{': {k: i for i, k in enumerate(keys)}, "t": {k: text() for k in keys},
               "n": {k: r.choice([None, {"x": [1, 2, {"y": "},{"}]}, [3, "a,b"]]) for k in keys}, "f": {k: r.random() for k in keys}}
    path = tmp_path / "cut.json"
    path.write_text(json.dumps(columns, indent=indent, ensure_ascii=False))
    before = {c: spark.conf.get(f"spark.sql.files.{c}") for c in ("maxPartitionBytes", "openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = read_table(spark, str(path))
        assert [t for _, t in df.dtypes] == ["bigint", "string", "string", "double"] and df.columns == list(columns)
        got = {row[0]: (row[1], row[2] and json.loads(row[2]), row[3]) for row in df.collect()}
        assert got == {i: tuple(columns[c][k] for c in "tnf") for i, k in enumerate(keys)}
        written = spark.createDataFrame(list(zip(keys, [text() for _ in keys], range(40))), "key string, t string, i long")
        write_columns(written.repartition(5), "key", str(tmp_path / "own.json"))
        assert sorted(map(tuple, read_table(spark, str(tmp_path / "own.json")).collect())) == sorted((row.t, row.i) for row in written.collect())
    finally:
        for c, value in before.items():
            spark.conf.set(f"spark.sql.files.{c}", value)


def test_columns_are_not_one_value_in_one_task(spark, tmp_path):
    """The written document lies in several files, and a second line or file of the same kind is no part of the first."""
    rows = spark.range(5000).select(F.col("id").cast("string").alias("key"), "id")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_columns(rows, "key", str(tmp_path / "many.json"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted((tmp_path / "many.json").glob("part-*"))
    assert len(parts) > 1 and len(json.loads("".join(p.read_text() for p in parts))["id"]) == 5000
    assert read_table(spark, str(tmp_path / "many.json")).agg(F.sum("id")).first()[0] == 5000 * 4999 // 2
    one = '{"p": {"x": 1}, "q": {"x": 2}}\n'
    (tmp_path / "two.json").write_text(one * 2)
    (tmp_path / "files.json").mkdir()
    for i in range(2):
        (tmp_path / "files.json" / f"{i}.json").write_text(one)
    for title in ("two", "files"):
        df = read_table(spark, str(tmp_path / f"{title}.json"))
        assert df.columns == ["p", "q"] and df.count() == 2, title
    with pytest.raises(ValueError):
        write_columns(spark.createDataFrame([("a", 1), ("a", 2)], "key string, v int"), "key", str(tmp_path / "twice.json"))
