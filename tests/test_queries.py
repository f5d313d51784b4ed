"""Every named query against its oracle on whole tables, and the shape of its plan."""

import pytest

import __spark_entry__ as entry_module
from profilewatch.plans.oracle import ORACLE
from profilewatch.plans.queries import QUERIES
from tests.compare import connect, differences

#: Every query has its SQL.
NO_ORACLE: set[str] = set()
#: A detector from outside; captured_rows_roundtrip reads what Python has already written.
USES_PYTHON = {"gate_foreign_detector"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == NO_ORACLE and set(ORACLE) <= set(QUERIES)
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLE.items() <= entry_module.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in NO_ORACLE:
        assert df.count() > 0
    else:
        assert differences(df, con, ORACLE[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert ("EvalPython" in plan) == (name in USES_PYTHON)


def test_entry_is_the_panel(spark):
    row = entry_module.entry(spark).first()
    assert row["sample_count"] > 0 and row["reference_n_requests"] > 0
