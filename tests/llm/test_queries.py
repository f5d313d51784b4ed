"""The registered queries against their SQL, and what is registered."""

import pytest

import __spark_entry__ as entry_module
from profilewatch.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences


def test_one_query_for_every_operator_and_the_pipeline():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= entry_module.queries().keys()
    assert ORACLE.items() <= entry_module.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []
