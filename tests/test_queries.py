"""Every registered query against its SQL on DuckDB."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF = os.environ.get("FAIRLAKE_TEST_SF", "/root/testdata/sf0.001")
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert differences(got, duck.execute(SQL[name]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
