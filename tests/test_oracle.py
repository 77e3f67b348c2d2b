"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from leafmill.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    want = duck.execute(SQL[name])
    cols = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(cols) == sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in got.select(*cols).collect()), key=key)
    assert a == b
