"""Registered queries against their SQL, on whole tables."""

import duckdb
import pytest

from quinhao.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name, rows_of):
    db = duckdb.connect()
    for name_of_table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name_of_table} AS FROM '{SF}/{name_of_table}.parquet'")
    want = db.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = sorted(want.fetchall(), key=repr)
    assert rows and rows_of(queries()[name](spark, SF).select(*columns)) == rows
