"""Operators next to their DuckDB twins."""

import os

import duckdb
import pytest

from chronofold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, sf_dir, name):
    folder = os.environ.get("TWIN_DIR", sf_dir)
    frame = queries.queries()[name](spark, folder)
    base = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        base.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    twin = base.sql(queries.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(twin.columns)
    want = [tuple(row[twin.columns.index(c)] for c in columns) for row in twin.fetchall()]
    got = [tuple(row[c] for c in columns) for row in frame.collect()]
    assert sorted(got) == sorted(want)
