"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from tools import check

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == check.rows_of(names, result.fetchall())
