"""Every registered query of the event store against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from sightline import catalog_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v


@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_query(spark, con, name):
    got = catalog_queries.queries()[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    sql = catalog_queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert rows and sorted(rows, key=key) == sorted(want, key=key)
