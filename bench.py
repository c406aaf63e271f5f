"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the number of local cores. The derived tables
that stand for stored ones are written first and timed as ``prepare``; every query then runs once,
start to finish, with all of its result rows produced. The first query warms the JVM up and is not
counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from depthspark import new_session
from depthspark.plans.fixtures import Tables
from depthspark.plans.queries import all_queries, block_width

HEADLINES = """
parse_diffs explode_levels build_tickers message_rate
sequence_gaps sync_points sync_segments reconstruct_book first_seen with_distance book_at mids sweep_book
default_tier user_tier top_levels visible_books activity_events
validate_rules replace_rules compile_rules
coalesce_ticks feed_snapshot user_feed user_snapshot session_messages rule_change_requests
usage_fixed usage_by_month usage_report presence last_seen
plan_catalog quote_days check_money
fold_grants current_entitlement gift_grants access_state
order_details order_list current_order transition_audit reconcile callback_audit grants_from_success order_decision
constraint_audit user_directory
""".split()


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = new_session(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count())
    started = time.time()
    tables = Tables(spark, sf_dir, block_width(spark))
    tables.depth_levels, tables.feed_events, tables.depth_raw
    times = {"prepare": round(time.time() - started, 3)}
    queries = all_queries()
    for name in sys.argv[1:] or HEADLINES:
        started = time.time()
        run(queries[name](spark, sf_dir))
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
