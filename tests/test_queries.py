"""Each query with SQL gives the SQL's rows, on the smallest tables, where they are present."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from ionweave.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "lineitem part embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    c = sorted(frame.columns)
    return c, sorted(map(repr, frame[c].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    assert rows(entry.queries()[name](spark, str(DATA)).toPandas()) == rows(duck.execute(catalogue.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
