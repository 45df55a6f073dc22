import pytest
from sqlcheck import connection, same

from lcspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_its_sql(spark, data, name):
    same(queries.QUERIES[name](spark, data), connection(data), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    rows = [tuple(map(str, r)) for r in queries.QUERIES[name](spark, data).collect()]
    assert len(rows) == len(set(rows))
