"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from vexel.queries import registry


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.8g}")
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, db, sf, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    cur = db.execute(registry.SQL[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "id", "distance"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
