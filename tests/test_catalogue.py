"""Each registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from siftstone.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    out = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    got = sorted(repr(tuple(r)) for r in out.select(columns).collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())
