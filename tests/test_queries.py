"""Every registered query against its SQL, and what its plan must not hold."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import connect, oracle_rows, spark_rows

import __spark_entry__ as entry_point
from worktempo import oracle, registry

DATA = Path("/root/testdata/sf0.01")
QUERIES = registry.queries()
ORACLE = oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(str(DATA))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, con, name):
    got = spark_rows(QUERIES[name](spark, str(DATA)))
    want = oracle_rows(con, ORACLE[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "no rows: the check would say nothing"


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_plan_has_no_pairing_and_no_python(spark, name):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow", "PythonUDF", "ExistingRDD"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name, column", [("today_by_user", "ts"), ("leaderboard_7d", "ts"), ("projects", "ts")])
def test_range_reaches_the_scan(spark, name, column):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual({column}," in plan
    assert "props" not in plan and "value#" not in plan


def test_entry(spark):
    assert entry_point.entry(spark).columns[0] == "user_id"
