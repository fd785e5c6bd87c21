"""Every registered query of the library: the rows of its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from stepwright.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_match_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    q = duck.sql(registry.ORACLE_SQL[name])
    columns, rows = q.columns, q.fetchall()
    assert set(df.columns) == set(columns)
    key = lambda r: tuple(str(r[c] + 0.0 if isinstance(r[c], float) else r[c]) for c in sorted(columns))
    assert sorted(key(r.asDict()) for r in df.collect()) == sorted(key(dict(zip(columns, r))) for r in rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


@needs_tables
def test_entry_gives_agents_within_bounds(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["v_lo"] <= r["v"] <= r["v_hi"] <= 1 and r["v"] <= min(r["c"], r["g"]) for r in rows)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"core_operational", "merge_latest", "paired_tests"} <= set(entry.queries())


@needs_tables
def test_shares_sum_to_one(spark):
    sums = {}
    for r in registry.QUERIES["cg_matrix"](spark, SMALL).collect():
        sums[r["agent"]] = sums.get(r["agent"], 0) + r["share"]
    assert all(abs(x - 1) < 1e-4 for x in sums.values())
