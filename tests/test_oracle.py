"""Every named query against its SQL in DuckDB, value by value."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from commerce_spark import queries as commerce

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return str(v) if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(commerce.oracle_sql()))
def test_equals_sql(spark, data, duck, name):
    df = commerce.queries()[name](spark, data)
    told = duck.sql(commerce.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(told.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    order = [told.columns.index(c) for c in columns]
    assert mine == sorted(repr([plain(r[k]) for k in order]) for r in told.fetchall())


def test_every_query_has_sql():
    assert set(commerce.queries()) == set(commerce.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
