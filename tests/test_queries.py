"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from binweave.plans import catalog

QUERIES, SQL = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = sorted(repr(tuple(row[i] for i in at)) for row in result.fetchall())
    assert len(found) == len(wanted)
    assert found == wanted


def test_entry(spark):
    assert driver.entry(spark).count() > 0
