"""Every query against its oracle SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from haulmark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_oracle(spark, duck, name):
    f, sql = QUERIES[name]
    df = f(spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    rows = sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 240
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
