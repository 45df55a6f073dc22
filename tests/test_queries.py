import pytest
from sqlcheck import connection, same

from lcspark.plans import align, features, graphs, ions, prep, scans, shape, spectra, streams, study, traces, truth

MODULES = (prep, traces, shape, features, spectra, streams, graphs, align, truth, ions, study, scans)
QUERIES = {k: (f, m.ORACLES.get(k)) for m in MODULES for k, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in QUERIES.items() if sql))
def test_equals_its_sql(spark, data, con, name):
    f, sql = QUERIES[name]
    same(f(spark, data), con, sql)


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in QUERIES.items() if not sql))
def test_runs(spark, data, name):
    df = QUERIES[name][0](spark, data)
    assert len(df.collect()) == len(set(map(tuple, (map(str, r) for r in df.collect()))))
