"""The driver's contract: every query runs, and equals its SQL where it has one."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from callatlas.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).columns
