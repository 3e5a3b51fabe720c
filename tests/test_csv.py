import random

import pyarrow as pa
import pytest

from tribunal import read_table
from tribunal.sources.readers import UnsupportedFormat, _whole_records, csv_records, read_csv


def _cell(r):
    text = "".join(r.choice(['a', 'b,', '"', '\n', ' ', 'é', 'x' * 9]) for _ in range(r.randint(0, 12)))
    return text, '"' + text.replace('"', '""') + '"'


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_records_equal_those_of_one_task(spark, tmp_path, seed, split):
    r = random.Random(seed)
    expected = []
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for part in range(3):
        rows = []
        for i in range(60):
            (a, qa), (b, qb) = _cell(r), _cell(r)
            if r.random() < 0.6:
                a = qa = f"plain{i}"
            expected.append((part * 1000 + i, f"<{a}>", f"<{b}>"))
            rows.append(f'{part * 1000 + i},"<{qa[1:-1] if qa[0] == chr(34) else qa}>","<{qb[1:-1]}>"')
        (folder / f"part-{part}.csv").write_text("id,one,two\n" + "\n".join(rows) + ("\n" if part else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = read_table(spark, str(folder))
        assert sorted(map(tuple, got.collect())) == sorted(expected)
        if split == 64:
            assert spark.read.text(str(folder)).rdd.getNumPartitions() > 30
        one = spark.read.csv(str(folder), header=True, multiLine=True, escape='"')
        assert sorted((int(x.id), x.one, x.two) for x in one.collect()) == sorted(expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_a_quote_that_is_never_closed(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('id,note\n1,"first\n2,second\n')
    with pytest.raises(UnsupportedFormat):
        read_csv(spark, str(path))


def test_heads_and_short_records(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_bytes(b'"id\nno",,x,x\r\n1,"a\r\nb",2\r\n\r\n3,,,"q"\r\n')
    df = read_csv(spark, str(path))
    assert df.columns == ["id\nno", "_c1", "x2", "x3"]
    assert sorted(map(tuple, df.collect())) == [(1, "a\r\nb", 2, None), (3, None, None, "q")]
    assert csv_records(spark, str(path)).count() == 3


def test_only_what_crosses_a_block_is_left_to_others():
    """Records inside a block come whole, whatever their lines; a block has two loose ends at most."""
    lines = [("f", 0, 0, "id,t", 0, 0), ("f", 0, 1, '1,"a', 1, 0), ("f", 0, 2, 'b"', 1, 0), ("f", 0, 3, '2,"c', 1, 0),
             ("f", 9, 4, "d", 0, 1), ("f", 20, 5, 'e"', 1, 1), ("f", 20, 6, "\r", 0, 1), ("f", 20, 7, "3,g", 0, 1)]
    names = ["file", "block", "at", "value", "odd", "parity"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in lines[a:a + 3]]) for a in (0, 3, 6)]
    found = [tuple(r.values()) for b in _whole_records(iter(batches)) for r in b.to_pylist()]
    assert found == [
        ("f", 0, 0, "id,t", 0, True), ("f", 0, 1, '1,"a\nb"', 0, False), ("f", 0, 3, '2,"c', 2, False), ("f", 9, 4, "d", 1, False),
        ("f", 20, 5, 'e"', 1, False), ("f", 20, 6, "\r", 0, False), ("f", 20, 7, "3,g", 0, True)]
