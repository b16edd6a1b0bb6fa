"""Every query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from mediacat.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in core._ALL:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in core.ORACLE_SQL:
        r = duck.execute(core.ORACLE_SQL[name])
        assert got == rows([c[0] for c in r.description], r.fetchall())


def test_plans(spark):
    plan = lambda name: core.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan("near_duplicate_join") + plan("within_radius")
    assert "WindowGroupLimit" in plan("select_best")
    assert "PushedFilters: [IsNotNull(vec_id)" in plan("get_embedding")
