import pytest

from lectern.llm import queries as q
from tests.oracle import connection, same

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() >= 0 and len(df.columns) == len(set(df.columns))
