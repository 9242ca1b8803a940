"""Every query with SQL agrees with it on the smallest tables; the others give rows of a stable schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from verify import normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry(spark):
    assert len(entry.entry(spark).collect()) > 0


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
