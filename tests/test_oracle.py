"""Every registered query with SQL gives the same rows in Spark and in DuckDB, without cross joins."""

import pytest
from oracle_check import compare, connect

from terralex.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    problem = compare(df, con, ORACLES[name])
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
