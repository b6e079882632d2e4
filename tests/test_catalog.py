"""Every named query with SQL must equal it; none may plan a cross join."""

import pytest
from compare import connect, difference, load_entry

ENTRY = load_entry()
ORACLES = ENTRY.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, folder, con, name):
    df = ENTRY.queries()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert difference(df, con, ORACLES[name]) is None


def test_entry(spark):
    rows = ENTRY.entry(spark).collect()
    assert rows and set(rows[0].asDict()) >= {"gate", "utilization", "efficiency"}
