"""Every query with an SQL counterpart, side by side with DuckDB."""

import pytest

import __spark_entry__ as E
from compare import database, differences

QUERIES, ORACLE = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    return database(folder)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("title", sorted(ORACLE))
def test_matches_sql(spark, folder, db, title):
    assert differences(QUERIES[title](spark, folder), db, ORACLE[title]) == []
