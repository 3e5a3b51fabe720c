"""One JSON object of columns, ``{"a": {"0": 1, "1": 2}, "b": {…}}``, written and read by as many tasks as any text.

The document may be one file or several that follow each other by name, with
or without line breaks.  It is read in pieces between commas.  Quotes and
brackets of whole blocks of the files, one row each, are summed up in file
order and tell where a block starts: inside a text, how deep.  A comma at depth
1 or 2 ends a cell; every task puts the cells inside its blocks together, and
only what crosses the end of a block is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tribunal.session import freeze, ship_package

_KINDS = {"integers": "bigint", "doubles": "double", "booleans": "boolean"}
#: A cell that needs no parser: key and bare token or text without escapes, but for the texts that may be read as numbers.
_PLAIN = (r'^\s*"([^"\\\x00-\x1f]*)"\s*:\s*(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null'
          r'|"(?![-+]?(?:I|NaN))[^"\\\x00-\x1f]*")\s*$')
_UNIT = "file string, block long, at long, text string, opened int, closed int, col long, edge int"


def write_columns(rows: DataFrame, key: str, path: str) -> None:
    """Write ``rows`` as one object of columns, each from row key to cell, sorted by key; the files follow each other by name."""
    columns = [c for c in rows.columns if c != key]
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.bool_or((F.col("n") > 1) | F.col(key).isNull()), F.lit(False)).alias("wrong"), F.min(key).alias("first")).first()
    if repeated["wrong"]:
        raise ValueError("Row keys of a JSON object of columns must be there and differ.")
    comma = F.when(F.col(key) == F.lit(repeated["first"]), "").otherwise(",")

    def cell(c: str) -> Column:
        text = F.to_json(F.create_map(key, c))
        return F.concat(comma, F.substr(text, F.lit(2), F.length(text) - 2))

    cells = rows.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("_column"), F.lit(1).alias("_part"), cell(c).alias("value"))
                                                for i, c in enumerate(columns)])))
    ends = []
    for i, c in enumerate(columns):
        ends.append((None, i, 0, ("," if i else "{") + json.dumps(c, ensure_ascii=False) + ":{"))
        ends.append((None, i, 2, "}" if i < len(columns) - 1 else "}}"))
    frame = rows.sparkSession.createDataFrame(ends, T.StructType([T.StructField(f.name, f.dataType) for f in cells.schema]))
    cells.unionByName(frame).orderBy("_column", "_part", key).select("value").write.text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value, odd, d0, d1, b0, b1): text between commas; whether its quotes are odd, and, if it starts outside
    and inside a text, how much deeper it ends and whether something follows a closed bracket, as no comma does."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", bare.alias("_bare"))
    found = []
    for start, text in enumerate((F.col("_bare"), F.regexp_replace("_bare", r'^[^"]*("|\z)', ""))):
        outside = F.regexp_replace(text, r'"[^"]*("|\z)', "s")
        found += [
            (F.length(F.translate(outside, "}]", "")) - F.length(F.translate(outside, "{[", ""))).alias(f"d{start}"),
            outside.rlike(r"[}\]]\s*[^}\]\s]").cast("int").alias(f"b{start}")]
    odd = (F.length("_bare") - F.length(F.replace("_bare", F.lit('"')))) % 2
    return pieces.select("file", "block", "value", odd.cast("int").alias("odd"), *found)


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((file, block), start, end) of the runs of one block in a batch."""
    files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
        yield (files.dictionary[int(codes[a])].as_py(), int(blocks[a])), a, b


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the pieces (file, block, odd, d0, d1, b0, b1) of blocks, if these start outside and inside a text."""
    where, parity = None, 0
    for batch in batches:
        if not len(batch):
            continue
        odd, d0, d1, b0, b1 = (batch.column(i).to_numpy() for i in range(2, 7))
        rows = []
        for block, a, b in _segments(batch):
            if block != where:
                where, parity = block, 0
            before = (parity + np.cumsum(odd[a:b]) - odd[a:b]) % 2
            own = [int(np.where(before == s, x[a:b], y[a:b]).sum()) for x, y in ((d0, d1), (b0, b1)) for s in (0, 1)]
            parity = (parity + int(odd[a:b].sum())) % 2
            rows.append((*block, int(odd[a:b].sum()), *own))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "block", "odd", "d0", "d1", "b0", "b1"])


def _starts(pieces: DataFrame) -> dict[tuple[str, int], tuple[int, int]] | None:
    """(parity of quotes, depth) before each block, one entry a block; None if the files are not one value."""
    sums = pieces.select("file", "block", "odd", "d0", "d1", "b0", "b1").mapInArrow(_summed, "file string, block long, odd long, d0 long, d1 long, b0 long, b1 long").groupBy(
        "file", "block").agg(*[F.sum(c).alias(c) for c in ("odd", "d0", "d1", "b0", "b1")])
    starts, parity, depth = {}, 0, 0
    for r in sums.orderBy("file", "block").collect():
        if starts and not parity and depth == 0 or r[f"b{parity}"]:
            return None
        starts[r["file"], r["block"]] = (parity, depth)
        depth += r[f"d{parity}"]
        parity = (parity + r["odd"]) % 2
    return starts if starts and (parity, depth) == (0, 0) else None


def _units(pieces: DataFrame, starts: dict[tuple[str, int], tuple[int, int]]) -> DataFrame:
    """(file, block, at, text, opened, closed, col): what stands between commas at depth 1 and 2, the depths before and after
    it, and the place in the block of the last one that names a column (null: in a block before)."""
    very_first = min(starts)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, parity, depth, at, col = None, 0, 0, 0, None
        held: list | None = None        # at, texts, depth before, col, whether it begins in an earlier block
        out: list[tuple] = []

        def put(closed: int, last: bool) -> None:
            edge = 1 if held[4] else 2 if last else 0
            out.append((*where, held[0], held[1][0] if len(held[1]) == 1 else ",".join(held[1]), held[2], closed, held[3], edge))

        def batch_of() -> pa.RecordBatch:
            names, types = ["file", "block", "at", "text", "opened", "closed", "col", "edge"], [
                pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            if not len(batch):
                continue
            odd, d0, d1 = (batch.column(i).to_numpy() for i in range(3, 6))
            values = batch.column(2).to_pylist()
            for block, a, b in _segments(batch):
                if block != where:
                    if held is not None:
                        put(depth, True)
                    where, at, col, held = block, 0, None, None
                    parity, depth = starts[block]
                before = (parity + np.cumsum(odd[a:b]) - odd[a:b]) % 2
                deeper = np.where(before == 0, d0[a:b], d1[a:b])
                deep = depth + np.cumsum(deeper) - deeper
                begins = (before == 0) & (deep <= 2)
                if at == 0 and block[1] == 0:
                    begins[0] = block == very_first
                cuts = np.flatnonzero(begins).tolist()
                first = cuts[0] if cuts else b - a
                if first:
                    if held is None:        # the line break stands for the end of the file before
                        held = [at, [("\n" if block[1] == 0 else ",") + values[a], *values[a + 1:a + first]], int(deep[0]), None, True]
                    else:
                        held[1] += values[a:a + first]
                for i, j in zip(cuts, [*cuts[1:], b - a]):
                    if held is not None:
                        put(int(deep[i]), False)
                    if deep[i] <= 1:
                        col = at + i
                    held = [at + i, values[a + i:a + j], int(deep[i]), col, False]
                depth += int(deeper.sum())
                parity = (parity + int(odd[a:b].sum())) % 2
                at += b - a
            if out:
                yield batch_of()
                out = []
        if held is not None:
            put(depth, True)
            yield batch_of()

    known = pieces.select("file", "block", "value", "odd", "d0", "d1").mapInArrow(whole, _UNIT)
    # Two a block at most: the last one may go on in the blocks that follow.
    edges = known.filter("edge > 0").withColumn("_owner", F.last(F.when(F.col("edge") == 2, F.struct("file", "block", "at")), True).over(
        Window.partitionBy(F.lit(0)).orderBy("file", "block", "at")))
    joined = edges.groupBy("_owner").agg(F.array_sort(F.collect_list(
        F.struct("file", "block", "at", "text", "opened", "closed", "col"))).alias("_p")).select(
        "_owner.file", "_owner.block", "_owner.at", F.array_join(F.transform("_p", lambda x: x["text"]), "").alias("text"),
        F.col("_p")[0]["opened"].alias("opened"), F.element_at("_p", -1)["closed"].alias("closed"), F.col("_p")[0]["col"].alias("col"))
    return known.filter("edge = 0").drop("edge").unionByName(joined)


def _cells(units: DataFrame) -> DataFrame:
    """(file, block, at, col, title, key, value, good, <kinds>): the cell of each unit; a kind says whether it can be read as one."""
    around = F.element_at(F.array(F.lit(""), F.lit("{"), F.lit('{"":{')), F.col("opened") + 1)
    alone = F.concat(around, "text", F.repeat(F.lit("}"), F.greatest("closed", F.lit(0))))
    plain = (F.col("opened") == 2) & (F.col("closed") == 2) & F.col("text").rlike(_PLAIN)
    whole = units.withColumns({"_plain": plain, "_alone": alone}).withColumn(
        "_raw", F.when(F.col("_plain"), F.regexp_extract("text", _PLAIN, 2)))

    def held(kind: str) -> Column:
        return F.from_json("_alone", f"map<string,map<string,{kind}>>")

    read = whole.withColumn("_m", F.when(~F.col("_plain"), held("string")))
    body = F.get(F.map_values("_m"), F.lit(0))
    good = F.col("_plain") | ((F.size("_m") == 1) & (F.size(body) == 1))
    quoted = F.col("_raw").startswith('"')
    value = F.when(quoted, F.substr("_raw", F.lit(2), F.length("_raw") - 2)).when(F.col("_raw") != "null", F.col("_raw"))
    found = read.select(
        "file", "block", "at", "col", "_alone", "_plain", "_raw", F.when(F.col("opened") < 2, F.get(F.map_keys("_m"), F.lit(0))).alias("title"),
        F.when(F.col("_plain"), F.regexp_extract("text", _PLAIN, 1)).otherwise(F.get(F.map_keys(body), F.lit(0))).alias("key"),
        F.when(F.col("_plain"), value).otherwise(F.get(F.map_values(body), F.lit(0))).alias("value"),
        F.coalesce(good, F.lit(False)).alias("good"))
    number = ~quoted & F.col("_raw").rlike(r"\d$")
    easy = {"integers": number & F.col("_raw").try_cast("bigint").isNotNull() & ~F.col("_raw").rlike("[.eE]"), "doubles": number,
            "booleans": F.col("_raw").isin("true", "false")}
    # Only what looks like one is read as one: a failure costs the parser much more than a success.
    alike = {"integers": F.col("value").rlike(r"^[-+]?\d+$"), "doubles": F.col("value").rlike(r"^[-+]?(\d|\.|I|NaN)"),
             "booleans": F.col("value").isin("true", "false")}
    return found.select("file", "block", "at", "col", "title", "key", "value", "good", *[
        F.when(F.col("_plain"), easy[c].cast("int")).when(
            alike[c], F.get(F.map_values(F.get(F.map_values(held(kind)), F.lit(0))), F.lit(0)).isNotNull().cast("int"))
        .otherwise(0).alias(c) for c, kind in _KINDS.items()])


def _may_be_columns(spark: SparkSession, path: str) -> bool:
    """Whether the text can start with an object whose first member is an object; unknown counts as yes."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return False
    pieces = spark.read.option("lineSep", ",").text(path).filter((F.col("_metadata.file_path") == files[0]) & (F.col("_metadata.file_block_start") == 0))
    first = pieces.select(F.substring("value", 1, 10_000).alias("value")).first()
    return first is None or bool(spark.range(1).select(
        ~F.lit(first["value"]).rlike(r'^\s*([^{\s]|\{\s*([^"\s]|"[^"\\]*(?:\\.[^"\\]*)*"\s*:\s*[^{\s]))')).first()[0])


def read_columns(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of a JSON object of columns that all have the same keys, in the order of these; None if the files hold something else.

    Row keys are data: the plan does not depend on how many there are.  A
    column's type is the narrowest into which all its cells can be read.
    """
    if not _may_be_columns(spark, path):
        return None
    ship_package(spark)
    pieces = _pieces(spark, path)
    starts = _starts(pieces)
    if starts is None:
        return None
    cells = _cells(_units(pieces, starts))
    # One row a block and a column.
    facts = cells.groupBy("file", "block", "col").agg(
        F.bool_and("good").alias("good"), F.max("title").alias("title"), F.count("value").alias("present"),
        *[F.sum(c).alias(c) for c in _KINDS]).collect()
    facts.sort(key=lambda r: (r["file"], r["block"], -1 if r["col"] is None else r["col"]))
    if not facts or facts[0]["col"] is None or not all(r["good"] for r in facts):
        return None
    columns, places = [], {}
    for r in facts:
        if r["col"] is not None:
            columns.append({"title": r["title"], "present": 0, **dict.fromkeys(_KINDS, 0)})
        places[r["file"], r["block"], r["col"]] = len(columns) - 1
        for c in ("present", *_KINDS):
            columns[-1][c] += r[c]
    table = spark.createDataFrame([(*k, n) for k, n in places.items()], "_file string, _block long, _col long, _n int")
    placed = cells.join(F.broadcast(table), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
                        & F.col("col").eqNullSafe(F.col("_col")))
    ids = range(len(columns))
    rows = freeze(placed.groupBy("key").agg(*[e for n in ids for e in (
        F.max(F.when(F.col("_n") == n, F.col("value"))).alias(f"v{n}"), F.count(F.when(F.col("_n") == n, 1)).alias(f"n{n}"))]))
    if len(columns) > 1 and not rows.agg(F.bool_and(reduce(lambda a, b: a & b, [F.col(f"n{n}") == F.col("n0") for n in ids[1:]]))).first()[0]:
        return None
    out = []
    for c in columns:
        same = [F.col(f"v{n}") for n in ids if columns[n]["title"] == c["title"]]
        out.append((F.greatest(*same) if len(same) > 1 else same[0]).cast(_kind(c)).alias(c["title"]))
    return rows.orderBy(F.col("key").try_cast("bigint"), "key").select(*out)


def _kind(column: dict) -> str:
    # A text of digits is a text: only bare numbers can be read as numbers.
    if not column["present"]:
        return "double"
    return next((kind for c, kind in _KINDS.items() if column[c] == column["present"]), "string")
