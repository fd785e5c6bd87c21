"""Queries with SQL: the same rows on odd tables and on empty ones, and whole on the smallest test tables."""

import os

import pytest

from stepwright.llm import registry

from .conftest import same, sql_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
@pytest.mark.parametrize("where", ["edge", "empty", "small"])
def test_query_has_the_rows_of_its_sql(spark, edge_dir, empty_dir, name, where):
    folder = {"edge": edge_dir, "empty": empty_dir, "small": SMALL}[where]
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    same(registry.QUERIES[name](spark, folder), *sql_rows(registry.ORACLE_SQL[name], folder))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_takes_odd_and_empty_tables(spark, edge_dir, empty_dir, name):
    n = {"op9": 9}.get(name.split("_")[0], 24)
    assert registry.QUERIES[name](spark, edge_dir).count() == n
    assert registry.QUERIES[name](spark, empty_dir).count() == 0
