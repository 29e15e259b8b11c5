"""Every registered query against its SQL, or against a shape it must have."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, connection, name):
    assert difference(QUERIES[name](spark, small), connection, SQL[name]) is None


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    # order and part keys and the price are numbers; ten suppliers in 6,000 rows are categories
    row = entry.entry(spark).first()
    assert (row["columns"], row["numeric_columns"], row["datetime_columns"]) == (11, 3, 1)
