"""The registered view of the books shows all of their changes."""

from __future__ import annotations

import pytest

from depthspark.plans.queries import all_queries, books

LINES = ("l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate date, "
         "l_quantity double, l_linestatus string")


@pytest.mark.parametrize("as_of_ms", [books.AS_OF_MS, books.START_MS])
def test_the_view_shows_the_last_changes_too(spark, folder, monkeypatch, as_of_ms):
    n = 450
    spark.createDataFrame([(i, 1, 0, 8, 4.0 * (1000 + i), None, 1.0, "O") for i in range(1, n + 1)], LINES).write.parquet(f"{folder}/lineitem.parquet")
    live, seen = {}, {}
    for i in range(1, n + 1):
        price = 880.0 + (7 * i + 1) % 240
        if (i + 1) % 17 == 0:
            live.pop(price, None)
            continue
        if price not in live:
            seen[price] = books.START_MS + 50 * i
        live[price] = 4.0 * (1000 + i)
    bids, asks = [p for p in live if p < 1000], [p for p in live if p >= 1000]
    mid = (max(bids) + min(asks)) / 2
    shown = [p for p in live if 0.9 * mid <= p <= 1.1 * mid]
    moment = max(as_of_ms, books.START_MS + 50 * n)

    monkeypatch.setattr(books, "AS_OF_MS", as_of_ms)
    view = all_queries()["book_view"](spark, folder).collect()
    assert {r["price"]: (r["qty"], r["lifetime_ms"]) for r in view} == {p: (live[p], moment - seen[p]) for p in shown}
    assert len(view) == len(shown)
    assert {(r["bid_count"], r["ask_count"]) for r in view} == {(sum(p < 1000 for p in shown), sum(p >= 1000 for p in shown))}
    assert {r["state"] for r in view} == {"SYNCED"}
