"""Every registered query against its DuckDB twin, and what its plan must not contain."""

import duckdb
import pytest

import __spark_entry__ as contract
import catalog
from catalog.check import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())  # the optional training-data queries have tests of their own


@pytest.fixture(scope="module")
def connection():
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return database


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, connection, name):
    assert compare(spark, connection, SF_DIR, name).startswith("ok")


def test_every_query_has_a_twin():
    assert set(catalog.oracle_sql()) == set(NAMES)
    assert set(NAMES) <= set(contract.queries())
    assert catalog.oracle_sql().items() <= contract.oracle_sql().items()


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["user_id", "task_name", "total_time", "ratio"]
    assert frame.count() > 0


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("stream_")])
def test_plan_has_no_cross_join_python_or_forced_broadcast(spark, name):
    execution = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution()
    physical = execution.executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEvalPython", "MapInPandas"):
        assert forbidden not in physical
    assert "ResolvedHint" not in execution.optimizedPlan().toString()
    assert "strategy=broadcast" not in execution.optimizedPlan().toString()
