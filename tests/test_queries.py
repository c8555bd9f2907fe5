"""Every query runs on the smallest tables; those with a SQL twin agree with it."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if not n.startswith("p") or not n[1].isdigit() or n.startswith(("p3_", "p6_"))]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def compare(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        named = [d[0] for d in result.description]
        assert sorted(named) == columns
        want = sorted((tuple(plain(r[named.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        assert got == want


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    compare(spark, duck, name)
