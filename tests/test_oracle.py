"""Every query with SQL against DuckDB on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import difference, oracle_connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    mine = queries()[name](spark, sf_dir).toPandas()
    assert difference(mine, con.sql(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() == 100
