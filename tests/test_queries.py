import pytest

from chartspark import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, same, model):
    same(queries.QUERIES[name], queries.SQL[name], model)
