"""Compare a Spark result with a DuckDB result, ignoring row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        title = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"create view {title} as select * from read_parquet('{path}')")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 9) + 0.0
    return str(value)


def table_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark_df, connection, sql: str) -> list[str]:
    """Readable differences; empty when the results agree."""
    found = connection.execute(sql)
    expected_columns, expected = table_rows([d[0] for d in found.description], found.fetchall())
    columns, actual = table_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if columns != expected_columns:
        problems.append(f"columns {columns} != {expected_columns}")
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows != {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    problems += [f"{a}\n    != {e}" for a, e in wrong[:3]]
    if wrong:
        problems.append(f"{len(wrong)} rows differ")
    return problems
