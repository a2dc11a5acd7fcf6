"""Every registered workflow query against its DuckDB oracle, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tidemill.plans import registry

DATA = os.environ.get("TIDEMILL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_oracle(spark, oracle, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = oracle.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = Counter(str(tuple(r[columns.index(c)] for c in df.columns)) for r in cursor.fetchall())
    assert Counter(str(tuple(r)) for r in rows) == expected


def test_entry_is_not_empty(spark):
    df = registry.entry(spark, DATA)
    assert df.columns == ["workflow_id", "script_name", "state_name", "verdict"] and df.count() > 0


def test_no_query_pairs_everything_with_everything(spark):
    for name, build in registry.queries().items():
        plan = build(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_point_reads_reach_the_scan(spark):
    plan = registry.queries()["point_workflow"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,1234)" in plan and "o_totalprice" not in plan
