"""Every catalog query against the same query in DuckDB, and the entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from upliftforge.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "customer", "lineitem")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted((tuple(show(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    found = duck.sql(catalog.ORACLES[name])
    assert got == normal(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    row = entry.entry(spark).first()
    assert (row.points, row.qini_area, row.theoretical_random, row.qini_above_random) == (152, 41.241138, 31.539823, 9.701315)


def test_entry_points_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
