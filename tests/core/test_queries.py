import pytest

from papyrine.plans import catalog
from tests.oracle import same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    same(spark, name, QUERIES[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns
    df.collect()
