"""Every query that has SQL gives the same rows, columns, types and values in DuckDB."""

import pytest
from oracle import connect, differences

from tidemark.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "ArrowEval") if w in plan]
    assert differences(df, SQL[name], con) is None
