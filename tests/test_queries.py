"""Every registered query against its SQL twin, on the smallest tables."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.checking import difference, duckdb_tables

# Queries op<N>_* and the pipeline belong to a subpackage with tests of its own.
QUERIES, SQL = ({n: x for n, x in d.items() if not re.match(r"op\d+_|pipeline$", n)} for d in (queries(), oracle_sql()))


@pytest.fixture(scope="module")
def con(sf_dir):
    return duckdb_tables(sf_dir)


def test_entry_gives_words(spark, sf_dir):
    result = entry(spark)
    assert result.columns == ["key", "value"]
    assert result.where("key = '' or value < 1").count() == 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None
