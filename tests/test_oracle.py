"""Every registered query against its SQL, or at least against emptiness."""

import pytest

import oracle
from reportloom.plans import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, con):
    assert oracle.compare(QUERIES[name](spark, sf_dir), SQL[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark, sf_dir):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["area", "year", "n", "share_pct"]
    assert rows.count() > 0
