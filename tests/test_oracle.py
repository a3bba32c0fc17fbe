"""Every registered query against its SQL in DuckDB, value by value."""

import pytest

import __spark_entry__ as registry
from compare import differences, duck

SF_DIR = "/root/testdata/sf0.001"
# the training-data operators have tests of their own
OTHERS = registry._training_queries()
QUERIES = {name: query for name, query in registry.queries().items() if name not in OTHERS}
SQL = {name: sql for name, sql in registry.oracle_sql().items() if name not in OTHERS}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


def test_entry_gives_rows(spark):
    assert registry.entry(spark).count() > 0
