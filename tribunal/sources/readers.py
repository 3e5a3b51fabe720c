"""Table readers: the file extension picks the format."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tribunal.functions import rules
from tribunal.functions.columns import name
from tribunal.session import freeze, ship_package
from tribunal.sources.json_columns import read_columns


class UnsupportedFormat(ValueError):
    """The file is in a format that cannot be read."""


def read_table(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """Read ``.csv``, ``.json`` or ``.parquet``; anything else is tried as CSV.

    ``place`` names a column to add that sorts like the rows in the files:
    file, block of the file and place in it.  It needs no shuffle, and gives
    tables without a key an order of appearance.  JSON must be one record per
    line for it.
    """
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".json"):
        return read_json(spark, path, place)
    if lowered.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.withColumn(place, F.struct(
            F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"),
            F.col("_metadata.row_index").alias("at"))) if place else df
    if lowered.endswith((".xlsx", ".xls")):
        raise UnsupportedFormat("Spark has no spreadsheet reader. Save the sheet as CSV.")
    try:
        return read_csv(spark, path, place)
    except UnsupportedFormat:
        raise
    except Exception as error:
        raise UnsupportedFormat("Unsupported file format. Use CSV, JSON or Parquet.") from error


def _file_place() -> Column:
    """Sorts rows of text formats like the files: rows of a block come in order, so their running ids do, too."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"))


def read_csv(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """CSV with a header.

    All cells are read as text, the usual tokens for "missing" become null and
    the narrowest type that fits every present cell is found in one aggregate.
    A line with an odd number of quotes may end inside a cell; such input is
    first cut into records by ``csv_records``.
    """
    odd = _quotes(F.col("value")) % 2 == 1
    if spark.read.text(path).agg(F.bool_or(odd)).first()[0]:
        return infer_types(_parsed(_csv_records(spark, path), place), place=place)
    raw = spark.read.csv(
        path, header=True, inferSchema=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if not raw.columns:
        raise UnsupportedFormat("The file has no columns.")
    return infer_types(raw.withColumn(place, _file_place()) if place else raw, place=place)


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"')))


def _in_file_order(ends: DataFrame, *sums: str) -> DataFrame:
    """Add to blocks of files (file, block, <sums>) the sums of the blocks before them in their file, one row per block."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put lines (file, block, at, value, odd, parity) of blocks, which come in order, together to records.

    ``parity`` is that of the quotes before the block.  ``edge`` marks what may
    go on in another block: 1 the lines that end a record from before, 2 a
    record that has no end here; ``first`` the first record of a block.
    """
    held, where, inside, known = [], None, 0, False      # lines of the record at hand
    out: list[tuple] = []

    def put(edge: int) -> None:
        nonlocal held, known
        text = held[0][1] if len(held) == 1 else "\n".join(v for _, v in held)
        whole = not edge and text not in ("", "\r")
        out.append((*where, held[0][0], text, edge, whole and not known))
        held, known = [], known or whole

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()))],
            ["file", "block", "at", "text", "edge", "first"])

    carried = False
    for batch in batches:
        for f, b, a, v, o, p in zip(*(c.to_pylist() for c in batch.columns)):
            if (f, b) != where:
                if held:
                    put(1 if carried else 2)
                where, inside, known, carried = (f, b), p, False, bool(p)
            held.append((a, v))
            inside ^= o
            if not inside:
                put(1 if carried else 0)
                carried = False
        if out:
            yield batch_of()
            out = []
    if held:
        put(1 if carried else 2)
        yield batch_of()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, text): the records of CSV files with line breaks inside cells, read by as many tasks as any text."""
    return _csv_records(spark, path).drop("first")


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``csv_records``, and whether a record may be the first of its file.

    A line break ends a record where the quotes before it are even.  The
    parities of blocks of the files, one row each, are summed up in file order
    and tell where a block starts; every task then puts together the records
    inside its blocks.  Only what crosses the end of a block is shuffled.
    A quote that is never closed is an error.
    """
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", (_quotes(F.col("value")) % 2).cast("int").alias("odd"))
    ends = freeze(lines.groupBy("file", "block").agg(F.sum("odd").alias("odd")))
    if ends.groupBy("file").agg((F.sum("odd") % 2).alias("left")).filter("left = 1").limit(1).count():
        raise UnsupportedFormat("A quote in the file is never closed.")
    opens = _in_file_order(ends, "odd").select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), (F.col("odd_before") % 2).cast("int").alias("parity"))
    placed = lines.join(F.broadcast(opens), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    known = placed.select("file", "block", "at", "value", "odd", "parity").mapInArrow(
        _whole_records, "file string, block long, at long, text string, edge int, first boolean")
    # Two pieces a block at most; a record is one that has no end where it starts, with those that follow it.
    edges = known.filter("edge > 0").withColumn("_owner", F.last(
        F.when(F.col("edge") == 2, F.struct("block", "at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "edge")))
    joined = edges.groupBy("file", "_owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "edge", "text"))).alias("_pieces")).select(
        "file", "_owner.block", "_owner.at", F.array_join(F.transform("_pieces", lambda x: x["text"]), "\n").alias("text"),
        F.lit(True).alias("first"))
    text = F.regexp_replace("text", "\r$", "")
    return known.filter("edge = 0").drop("edge").unionByName(joined).withColumn("text", text).filter("text <> ''")


def _parsed(records: DataFrame, place: str | None = None) -> DataFrame:
    """The cells of records as text columns, named by the first record of each file."""
    heads = freeze(records.filter("first").groupBy("file").agg(F.min(F.struct("block", "at", "text")).alias("head")))
    first = heads.orderBy("file").first()
    if first is None:
        raise UnsupportedFormat("The file has no columns.")
    titles = next(csv.reader(io.StringIO(first["head"]["text"])))
    titles = [c or f"_c{i}" for i, c in enumerate(titles)]
    titles = [c + str(i) if titles.count(c) > 1 else c for i, c in enumerate(titles)]
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(titles))])
    taken = heads.select("file", F.col("head.block").alias("block"), F.col("head.at").alias("at"))
    cells = F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                       {"escape": '"', "multiLine": "true"})
    where = [F.struct("file", "block", "at").alias(place)] if place else []
    return records.join(taken, ["file", "block", "at"], "left_anti").select(cells.alias("c"), *where).select(
        *[F.col(f"c._{i}").alias(c) for i, c in enumerate(titles)], *([name(place)] if place else []))


def infer_types(raw: DataFrame, missing: list[str] = rules.CSV_MISSING, place: str | None = None) -> DataFrame:
    """Turn text columns into bigint, double or boolean where every cell fits; the column ``place`` stays."""
    texts = {c: F.when(name(c).isin(missing), F.lit(None)).otherwise(name(c)) for c in raw.columns if c != place}
    checks = []
    for i, text in enumerate(texts.values()):
        trimmed = F.trim(text)
        checks += [
            F.count(text).alias(f"n{i}"),
            F.count(F.when(trimmed.rlike(r"^[+-]?\d{1,19}$"), trimmed.try_cast("bigint"))).alias(f"i{i}"),
            F.count(F.when(~trimmed.rlike(r"[dDfF]$"), trimmed.try_cast("double"))).alias(f"d{i}"),
            F.count(F.when(trimmed.isin("True", "False", "true", "false", "TRUE", "FALSE"), 1)).alias(f"b{i}"),
        ]
    found = raw.agg(*checks).first()
    columns = []
    for i, (c, text) in enumerate(texts.items()):
        present = found[f"n{i}"]
        columns.append(_cast(text, present, found[f"i{i}"], found[f"d{i}"], found[f"b{i}"]).alias(c))
    return raw.select(*columns, *([name(place)] if place else []))


def _cast(text: Column, present: int, integers: int, doubles: int, booleans: int) -> Column:
    if present == 0:
        return text.cast("double")
    if integers == present:
        return F.trim(text).try_cast("bigint")
    if doubles == present:
        return F.trim(text).try_cast("double")
    if booleans == present:
        return F.lower(F.trim(text)).try_cast("boolean")
    return text


def read_json(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """An array of records, one record per line, or columns of row keys.

    Columns come in the order in which the records, one after the other, name
    them; the layout is judged by all lines.
    """
    columns = None if place else read_columns(spark, path)
    if columns is not None:
        return columns
    text = spark.read.text(path).filter(F.trim("value") != "")
    whole = F.trim("value").startswith("{") & F.get_json_object("value", "$").isNotNull()
    lines = bool(text.agg(F.bool_and(whole)).first()[0])
    if lines:
        objects = text.select("value")
    else:
        # One array is one value for the parser, too.
        file = spark.read.text(path, wholetext=True)
        parts = F.when(F.trim("value").startswith("{"), F.array("value")).otherwise(
            F.from_json("value", T.ArrayType(T.StringType())))
        objects = file.select(F.explode(parts).alias("value"))
    if place and not lines:
        raise UnsupportedFormat("The order of rows needs one JSON record per line.")
    if not place and objects.limit(2).count() == 1 and objects.select(_keyed_alike(F.col("value"))).first()[0]:
        return _from_columns(objects)
    df = spark.read.json(path, multiLine=not lines)
    if "_corrupt_record" in df.columns:
        raise UnsupportedFormat("The JSON text cannot be parsed.")
    return df.select(*[name(c) for c in _met_order(objects, df.columns)], *([_file_place().alias(place)] if place else []))


def _met_order(objects: DataFrame, columns: list[str]) -> list[str]:
    """Columns by the first record that names them; the inferred schema sorts them by name."""
    keys = objects.select(F.monotonically_increasing_id().alias("row"), F.json_object_keys("value").alias("keys"))
    first = keys.select("row", F.posexplode("keys").alias("place", "key")).groupBy("key").agg(
        F.min(F.struct("row", "place")).alias("met"))
    met = {r["key"]: (r["met"]["row"], r["met"]["place"]) for r in first.collect()}
    late = (float("inf"), 0)
    return sorted(columns, key=lambda c: (met.get(c, late), c))


def _keyed_alike(value: Column) -> Column:
    """Whether an object's members are objects, too, that all have the same keys, one at least."""
    members = F.map_values(F.from_json(value, "map<string,string>"))
    keys = F.transform(members, lambda m: F.array_sort(F.json_object_keys(m)))
    return F.coalesce((F.size(keys) > 0) & F.forall(keys, lambda k: (F.size(k) > 0) & (k == F.get(keys, F.lit(0)))), F.lit(False))


def _from_columns(objects: DataFrame) -> DataFrame:
    """Columns written as ``{"a": {"0": 1, "1": 2}}`` back into rows, in the order of their keys.

    Row keys are data: the plan does not depend on how many there are.  A
    column's type is the narrowest into which all its cells can be read.
    """
    columns = objects.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("place", "column", "body"))
    held = {kind: F.from_json("body", f"map<string,{kind}>") for kind in ("string", "bigint", "double", "boolean")}
    present = {kind: F.size(F.filter(F.map_values(m), lambda v: v.isNotNull())) for kind, m in held.items()}
    # A text of digits is a text: only bare numbers can be read as numbers.
    kind = F.lit("string")
    for narrow in ("boolean", "double", "bigint"):
        kind = F.when(present[narrow] == present["string"], narrow).otherwise(kind)
    kind = F.when(present["string"] == 0, "double").otherwise(kind)
    types = columns.select("place", "column", kind.alias("kind")).orderBy("place").collect()
    cells = columns.select("column", F.explode(held["string"]).alias("key", "value"))
    rows = cells.groupBy("key").agg(*[
        F.max(F.when(F.col("column") == r["column"], F.col("value"))).cast(r["kind"]).alias(r["column"]) for r in types])
    return rows.orderBy(F.col("key").try_cast("bigint"), "key").drop("key")
