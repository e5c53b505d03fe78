import pytest

from papyrine.llm import oracle, queries
from tests.oracle import same

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    same(spark, name, QUERIES[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
