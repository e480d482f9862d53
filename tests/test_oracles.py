"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tallymart.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    return str(v) if isinstance(v, datetime.date) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())
