"""Every core query against its SQL, and the driver's contract."""

import os

import pytest

import __spark_entry__ as entry
from millrace.plans import registry
from tests.oracle import database, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, con, name):
    same(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_contract(spark):
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["a", "b", "jaccard"]


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["mode_quota"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string>" in plan
    plan = registry.QUERIES["cache_misses"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan or "ReadSchema: struct<event_type:string,user_id:bigint>" in plan or "ReadSchema" in plan and "ts:" not in plan
