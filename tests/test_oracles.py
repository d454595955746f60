"""Every registered series query runs, and equals its DuckDB twin where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from seriesmill.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if sql := entry.oracle_sql().get(name):
        duck.execute(sql)
        columns = [c[0] for c in duck.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, duck.fetchall())


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 80
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_sum_of_squares_that_falls_to_a_unit_root(spark):
    """At this size two of the three series have no minimum short of one."""
    c, name, path = duckdb.connect(), "sarima_airline", SF.replace("0.01", "0.1")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet'")
    df = entry.queries()[name](spark, path)
    c.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([x[0] for x in c.description], c.fetchall())
