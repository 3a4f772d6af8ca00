"""Every registered query against its SQL, on whole tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = Path(os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01"))
ORACLE = entry_module.oracle_sql()
# the queries of the optional subpackage have tests of their own
QUERIES = {
    name: query
    for name, query in entry_module.queries().items()
    if name != "pipeline" and not name.startswith("op")
}

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return 0.0 if math.isclose(value, 0.0, abs_tol=1e-12) else value
        return value

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    result = QUERIES[name](spark, str(SF_DIR))
    expected = db.execute(ORACLE[name])
    columns = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(columns)
    want = rows_of(columns, expected.fetchall())
    got = rows_of(result.columns, result.collect())
    assert want, "a query without rows checks nothing"
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
