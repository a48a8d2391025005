"""Every registered query runs on the smallest tables; those with SQL equal DuckDB there."""

import datetime
import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OWN = [n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit())]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)[:19] if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        at = [d[0] for d in r.description]
        assert sorted(at) == cols
        assert got == sorted(tuple(plain(x[at.index(c)]) for c in cols) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
