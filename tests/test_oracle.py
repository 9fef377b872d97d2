"""Every query against its SQL, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
LLM = ("p3_", "p8_", "p9_", "p10_")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6g}" if float(v) else "0"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat().replace("T00:00:00", "") if hasattr(v, "isoformat") else str(v)


def table(cols, data):
    k = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in k], sorted(tuple(str(plain(r[i])) for i in k) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith(LLM)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
