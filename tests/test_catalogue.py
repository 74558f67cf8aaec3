"""Every query with SQL gives DuckDB's rows on the smallest tables; the driver's entry works."""

import os

import pytest

from webloom.plans import catalogue

DATA = os.environ.get("WEBLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for name in ("events", "documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(catalogue.oracle_sql()[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
