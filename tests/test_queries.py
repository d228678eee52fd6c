"""Every registered query: against DuckDB where it has SQL, else that it runs."""

import pytest
from compare import connect, duck_rows, spark_rows

import __spark_entry__ as entry_points

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    expected, _ = duck_rows(con, SQL[name])
    assert spark_rows(QUERIES[name](spark, sf_dir)) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
