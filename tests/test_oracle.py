"""Every registered query against its SQL in the other engine, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    r = duck.execute(entry.oracle_sql()[name])
    assert table(df.columns, [tuple(x) for x in df.collect()]) == table([d[0] for d in r.description], r.fetchall())



def test_entry(spark):
    assert entry.entry(spark).count() > 0
