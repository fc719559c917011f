"""Every query that has SQL gives the same names, rows and values as DuckDB on the same tables."""

import pytest
from oracle_check import connect, differences

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    assert differences(queries()[name](spark, sf_dir), duck, oracle_sql()[name]) is None


def test_sql_has_a_query_each():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() > 0
