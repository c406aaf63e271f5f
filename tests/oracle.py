"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

from depthspark.plans.fixtures import BASE_TABLES


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def bag(columns: list[str], rows) -> Counter:
    places = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(row[p]) for p in places) for row in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    started = time.time()
    ours = bag(df.columns, (tuple(r) for r in df.collect()))
    middle = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = bag(names, cur.fetchall())
    note = f"{sum(ours.values())} rows, {middle - started:.1f}s spark, {time.time() - middle:.1f}s duckdb"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if ours != theirs:
        only_ours, only_theirs = ours - theirs, theirs - ours
        return False, (f"{note}; {sum(only_ours.values())} only in spark {list(only_ours)[:3]}, "
                       f"{sum(only_theirs.values())} only in duckdb {list(only_theirs)[:3]}")
    return True, note


def main(sf_dir: str, names: list[str]) -> int:
    from depthspark import new_session
    from depthspark.plans.queries import all_queries, all_sql

    spark = new_session("local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false",
                        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql, bad = database(sf_dir), all_queries(), all_sql(), 0
    for name in names or queries:
        if name not in sql:
            print(f"{name}: no SQL, {queries[name](spark, sf_dir).count()} rows", flush=True)
            continue
        try:
            ok, note = compare(queries[name](spark, sf_dir), con, sql[name])
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name}: {note}", flush=True)
    print(f"{bad} bad", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
