"""Every query runs and those with SQL agree with it, on the smallest tables."""

import math
import os

import duckdb
import pytest

from docketforge import catalogue


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        res = con.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted((tuple(plain(x[i]) for i in at) for x in res.fetchall()), key=str)


def test_flagship(spark, sf):
    assert catalogue.flagship(spark, sf).count() > 0
