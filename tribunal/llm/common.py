"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tribunal.session import new_path, ship_package

#: One column holding a list of pieces no longer than this many rows per Arrow batch is handed back to Spark.
ROWS_OUT = 20_000


#: Schemes of Spark's file systems, and what Arrow calls them.
_STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, resolved once by Spark's own settings, so that Spark and the tasks mean the same.

    A plain path belongs to the cluster's default file system.  One that the
    tasks cannot reach through Arrow is refused.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = path.toUri().getScheme()
    if scheme is None:
        path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
        scheme = path.toUri().getScheme()
    if scheme not in _STORES:
        raise ValueError(f"Files cannot be written below {folder}: no file system for {scheme}.")
    whole = path.toString()
    return "file://" + path.toUri().getPath() if scheme == "file" else whole


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a qualified folder, and the folder's path in it; a plain path is local."""
    scheme, _, rest = folder.partition("://")
    return pafs.FileSystem.from_uri(f"{_STORES[scheme]}://{rest}" if rest else f"file://{folder}")


def table(spark: SparkSession, folder: str, title: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{title}.parquet")


def written(df: DataFrame, stem: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, stem)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare_workers(df: DataFrame) -> None:
    """Let Python workers import this package."""
    ship_package(df.sparkSession)


def total(df: DataFrame, column) -> int:
    """One number over the whole table."""
    return int(df.agg(F.sum(column)).first()[0] or 0)


def join_counted(
    rows: DataFrame, keyed: DataFrame, key: str, values: list[str], spread: list[str], most_hot: int = 10_000,
) -> DataFrame:
    """Rows whose ``key`` is in ``keyed``, which has it once, with its ``values``; ``rows`` is read once.

    ``keyed`` is a written table that counts in ``rows`` how many rows have the
    key.  Keys with at least one in ``most_hot`` of all of them (so at most that
    many keys) are broadcast; their rows pass the shuffle spread by a hash of
    the columns ``spread``, so no key fills a task.
    """
    least = -(-total(keyed, "rows") // most_hot)
    hot = keyed.where(F.col("rows") >= least).select(
        F.col(key).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot"))
    rest = keyed.where(F.col("rows") < least).select(
        F.lit(False).alias("_of"), F.col(key).alias("_key_of"), *[F.col(v).alias(f"_of_{v}") for v in values],
        F.lit(True).alias("_met"))
    flagged = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    dealt = flagged.withColumns({
        "_tier": F.coalesce("_hot", F.lit(False)),
        "_place": F.when(F.col("_hot"), F.xxhash64(*spread)).otherwise(F.col(key)),
    })
    met = dealt.join(rest, (F.col("_tier") == F.col("_of")) & (F.col("_place") == F.col("_key_of")), "left")
    return met.where(F.col("_tier") | F.col("_met")).select(
        *rows.columns, *[F.coalesce(f"_hot_{v}", f"_of_{v}").alias(v) for v in values])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column with the start and end of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds[:-1], bounds[1:]


def slices(starts: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes together, at least one row each."""
    first, n = 0, len(starts)
    while first < n:
        last = int(np.searchsorted(ends, starts[first] + limit, side="right"))
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def mixed(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one (xor-shift and multiply rounds)."""
    v = values.astype(np.uint64)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def range_codes(part: np.ndarray, opens: np.ndarray, closes: np.ndarray, byte: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of each byte range of ``part``, the same wherever the range stands."""
    weighted = byte[part] * _powers(_STEP, len(part))
    sums = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(weighted, out=sums[1:])
    back = _powers(_BACK, len(part) + 1)
    return mixed((sums[closes] - sums[opens]) * back[opens] + (closes - opens).astype(np.uint64))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows of a text column, as arrays.

    ``start`` and ``end`` are byte positions of each word, ``first`` the index
    of each row's first word (one entry more than rows), ``code`` a 64-bit
    hash of each word, of its A-Z lower-cased form if ``lower``.  ``breaks``
    marks the bytes between words, if not these blanks.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool,
                 breaks: np.ndarray = _SPACES):
        base = int(starts[0]) if len(starts) else 0
        part = raw[base:int(ends[-1])] if len(starts) else raw[:0]
        inner = ~breaks[part]
        # A word also ends where its row ends.
        row_start = np.zeros(len(part) + 1, dtype=bool)
        row_start[starts - base] = True
        before = np.empty(len(part), dtype=bool)
        if len(part):
            before[0] = False
            before[1:] = inner[:-1]
        opens = np.flatnonzero(inner & (~before | row_start[:-1]))
        after = np.empty(len(part), dtype=bool)
        if len(part):
            after[-1] = False
            after[:-1] = inner[1:]
        closes = np.flatnonzero(inner & (~after | row_start[1:])) + 1
        self.start, self.end = opens + base, closes + base
        self.first = np.searchsorted(opens, np.append(starts, ends[-1:] if len(ends) else []) - base)
        self.code = range_codes(part, opens, closes, _LOWER_BYTE if lower else _BYTE)


def shingle_codes(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbouring words."""
    out = np.zeros(max(0, len(code) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = mixed(out + code[k:k + len(out)] * np.uint64(2 * k + 3))
    return out


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Neighbouring stretches of ``data`` as binary values; ``sizes`` counts the items of each."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes * data.itemsize, out=offsets[1:])
    flat = pa.py_buffer(np.ascontiguousarray(data))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), flat]).cast(pa.binary())


def batches(schema: pa.Schema, columns: dict[str, np.ndarray | list]) -> Iterator[pa.RecordBatch]:
    """Hand columns back in batches of bounded row count."""
    arrays = [pa.array(columns[f.name], type=f.type) for f in schema]
    n = len(arrays[0]) if arrays else 0
    for i in range(0, n, ROWS_OUT):
        yield pa.RecordBatch.from_arrays([a.slice(i, ROWS_OUT) for a in arrays], schema=schema)
