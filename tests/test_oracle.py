"""Every query with SQL gives the same rows in Spark and DuckDB; the others run."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck, duck_rows, spark_rows

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, con, name):
    want = duck_rows(con, SQL[name])
    assert want[1], "the check compares nothing"
    assert difference(spark_rows(QUERIES[name](spark, sf_dir)), want) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20
    gaps = [r["discount_pct"] for r in rows]
    assert gaps == sorted(gaps, reverse=True)
