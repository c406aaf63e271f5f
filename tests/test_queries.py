"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entries
from depthspark.plans.fixtures import VIEWS, Tables, duckdb_sql
from depthspark.plans.queries import all_queries, all_sql
from tests.oracle import bag, compare, database

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def duck():
    return database(SMALL)


def test_entry(spark):
    df = entries.entry(spark)
    assert df.count() > 0 and "tier" in df.columns


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name not in SQL:
        assert df.count() > 0
        return
    ok, note = compare(df, duck, SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", ["depth_levels", "feed_events"])
def test_views_built_with_scans_equal_their_sql(spark, duck, name):
    df = getattr(Tables(spark, SMALL, 64), name)
    cur = duck.execute(duckdb_sql(f"SELECT * FROM {name}"))
    assert bag(df.columns, (tuple(r) for r in df.collect())) == bag([d[0] for d in cur.description], cur.fetchall())


def test_every_view_is_sql_for_both(spark, duck):
    tables = Tables(spark, SMALL)
    for name in VIEWS:
        assert sorted(getattr(tables, name).columns) == sorted(d[0] for d in duck.execute(duckdb_sql(f"SELECT * FROM {name} LIMIT 0")).description)


def test_levels_of_snapshots_meet_versions_in_buckets(spark, duck):
    df = Tables(spark, SMALL, 64)._snapshot_levels()
    cur = duck.execute(duckdb_sql("SELECT * FROM snapshot_levels"))
    assert bag(df.columns, (tuple(r) for r in df.collect())) == bag([d[0] for d in cur.description], cur.fetchall())
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and all("__bucket" in line for line in joins)
