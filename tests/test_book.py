from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from depthspark.operators import book
from tests.conftest import rows

CHANGES = "symbol string, market string, side string, price double, qty double, update_id bigint, recv_ms bigint"
DIFFS = "symbol string, market string, first_id bigint, final_id bigint, prev_final_id bigint, recv_ms bigint"


def test_gaps_by_market(spark):
    def run(market, ids):
        df = spark.createDataFrame([("A", market, *d, 100 * i) for i, d in enumerate(ids)], DIFFS)
        return [r["is_gap"] for r in book.sequence_gaps(df, 1).orderBy("recv_ms").collect()]

    assert run("SPOT", [(1, 3, 0), (4, 6, 0), (8, 9, 0), (10, 10, 0)]) == [False, False, True, False]
    assert run("FUTURES", [(1, 3, 0), (5, 6, 3), (8, 9, 6), (10, 12, 8)]) == [False, False, False, True]


def test_diffs_without_levels_never_break_and_bad_ones_always_do(spark):
    data = [("A", "SPOT", 1, 1, 0, 0, [1], [1], False), ("A", "SPOT", 9, 9, 0, 1, None, None, False),
            ("A", "SPOT", 10, 10, 0, 2, [1], None, False), ("A", "SPOT", 11, 11, 0, 3, [1], None, True)]
    df = spark.createDataFrame(data, DIFFS + ", bids array<int>, asks array<int>, bad boolean")
    assert [r["is_gap"] for r in book.sequence_gaps(df).orderBy("recv_ms").collect()] == [False, False, False, True]


def test_sync_needs_a_covering_diff_of_the_current_run(spark):
    diffs = [(10, 12, 0), (13, 15, 100), (16, 20, 200), (30, 31, 300), (32, 35, 400)]
    df = spark.createDataFrame([("A", "SPOT", a, b, 0, ms) for a, b, ms in diffs], DIFFS)
    snaps = {"covered": (14, 250), "on the edge": (12, 250), "not there yet": (18, 150), "before the buffer": (9, 250),
             "from an older run": (17, 350), "broken diff": (30, 450), "after the break": (33, 450)}
    asked = spark.createDataFrame([("A", "SPOT", *v) for v in snaps.values()],
                                  "symbol string, market string, snapshot_id bigint, recv_ms bigint")
    for width in (1, 1000):
        got = {(r["snapshot_id"], r["recv_ms"]): r["sync_id"]
               for r in book.sync_points(asked, book.with_segments(df, width), width).collect()}
        assert {k: got[v] for k, v in snaps.items()} == {
            "covered": 15, "on the edge": 12, "not there yet": None, "before the buffer": None, "from an older run": None,
            "broken diff": None, "after the break": 35}


def test_states_follow_runs(spark):
    diffs = [(1, 1), (2, 2), (3, 3), (9, 9), (10, 10), (11, 11), (20, 20)]
    df = spark.createDataFrame([("A", "SPOT", a, b, 0, 100 * i) for i, (a, b) in enumerate(diffs)], DIFFS)
    snaps = spark.createDataFrame([("A", "SPOT", 2, 150), ("A", "SPOT", 10, 450)],
                                  "symbol string, market string, snapshot_id bigint, recv_ms bigint")
    runs = book.with_segments(df)
    states = book.sync_segments(runs, book.sync_points(snaps, runs))
    assert rows(states, "segment", "state", "from_id", "to_id") == [
        (0, "SNAPSHOT_REQUESTED", 1, 1), (0, "SYNCED", 2, 3), (1, "PENDING", 9, 9), (1, "SYNCED", 10, 11), (2, "PENDING", 20, 20)]
    assert rows(book.sync_counts(states, 250)) == [("SPOT", 1)]
    assert rows(book.sync_counts(states, 300)) == []


def test_backlog_marks_the_longest_waiting(spark):
    states = spark.createDataFrame([(f"S{i}", "SPOT", "SNAPSHOT_REQUESTED", i, i * 10) for i in range(13)]
                                   + [("T", "SPOT", "SYNCED", 1, 5)],
                                   "symbol string, market string, state string, from_id bigint, from_ms bigint")
    admitted = {r["symbol"]: r["admitted"] for r in book.snapshot_backlog(states, 1000).collect()}
    assert len(admitted) == 13 and sum(admitted.values()) == 10 and not admitted["S12"]


def test_last_value_wins_and_zero_removes(spark):
    data = [("A", "SPOT", "BID", 10.0, 1.0, 1, 1, 0), ("A", "SPOT", "BID", 10.0, 2.0, 2, 2, 0), ("A", "SPOT", "BID", 10.0, 5.0, 2, 2, 1),
            ("A", "SPOT", "ASK", 12.0, 1.0, 1, 1, 0), ("A", "SPOT", "ASK", 12.0, 0.0, 3, 3, 0)]
    df = spark.createDataFrame(data, CHANGES + ", pos int")
    assert rows(book.reconstruct_book(df), "side", "price", "qty") == [("BID", 10.0, 5.0)]
    assert rows(book.reconstruct_book(df, as_of_id=2), "side", "qty") == [("ASK", 1.0), ("BID", 5.0)]
    snap = spark.createDataFrame([("A", "SPOT", "BID", 9.0, 4.0, 2), ("A", "SPOT", "BID", 8.0, 0.0, 2)],
                                 "symbol string, market string, side string, price double, qty double, snapshot_id bigint")
    # The diff with the snapshot's own id is applied after the load; older levels are gone.
    assert rows(book.reconstruct_book(df, snapshot_levels=snap), "price", "qty") == [(9.0, 4.0), (10.0, 5.0)]
    assert rows(book.reconstruct_book(df.filter("update_id <> 2"), snapshot_levels=snap), "price") == [(9.0,)]


def test_first_seen_starts_again_after_a_delete(spark):
    story = [(1, 5.0), (2, 6.0), (3, 0.0), (4, 0.0), (5, 2.0), (6, 3.0)]
    df = spark.createDataFrame([("A", "SPOT", "BID", 10.0, q, u, u * 10) for u, q in story], CHANGES)
    for width in (1, 1000):
        seen = {r["update_id"]: r["first_seen_ms"] for r in book.first_seen(df, width).collect()}
        assert seen == {1: 10, 2: 10, 3: None, 4: None, 5: 50, 6: 50}
    restarted = book.first_seen(df.withColumn("restart", F.col("update_id") == 6))
    assert {r["update_id"]: r["first_seen_ms"] for r in restarted.collect()}[6] == 60


@pytest.mark.parametrize("width", [1, 4, 30, 1000])
def test_first_seen_across_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(book, "LEVEL_STRETCH", 1)
    rng, changes, expected = random.Random(9), [], []
    for name, zeros in (("calm", 0.03), ("busy", 0.4)):
        held = None
        for u in sorted(rng.sample(range(-50, 400), 150)):
            qty = 0.0 if rng.random() < zeros else 1.0
            restart = rng.random() < 0.02
            held = None if not qty else u * 10 if held is None or restart else held
            changes.append((name, "SPOT", "BID", 10.0, qty, u, u * 10, restart))
            expected.append((name, u, held))
    df = spark.createDataFrame(changes, CHANGES + ", restart boolean")
    got = {(r["symbol"], r["update_id"]): r["first_seen_ms"] for r in book.first_seen(df, width).collect()}
    assert got == {(name, u): held for name, u, held in expected}


def test_band_is_inclusive_and_an_empty_side_is_left_alone(spark):
    data = [("A", "SPOT", s, p, 1.0, i, i) for i, (s, p) in enumerate(
        [("BID", 99.0), ("ASK", 101.0), ("BID", 90.0), ("BID", 89.9), ("ASK", 110.00000000000001), ("ASK", 110.1)])]
    data.append(("B", "SPOT", "BID", 5.0, 1.0, 9, 9))
    out = book.with_distance(spark.createDataFrame(data, CHANGES))
    assert rows(out.filter("symbol = 'A'"), "price") == [(90.0,), (99.0,), (101.0,), (110.00000000000001,)]
    assert rows(out.filter("symbol = 'B'"), "price", "mid", "distance") == [(5.0, None, None)]


@pytest.mark.parametrize("width", [3, 40, 10_000])
def test_mids_and_sweep_against_a_plain_replay(spark, width):
    rng, changes, expected, swept = random.Random(width), [], [], {}
    levels, live = {"BID": {}, "ASK": {}}, {}
    for u in range(1, 240):
        side = rng.choice(["BID", "ASK"])
        price = float(rng.randint(80, 99) if side == "BID" else rng.randint(101, 120))
        qty = rng.choice([0.0, 0.0, 4.0])
        changes.append(("A", "SPOT", side, price, qty, u, u))
        levels[side].pop(price, None)
        live.pop((side, price), None)
        if qty:
            levels[side][price] = qty
            live[side, price] = u
        bid, ask = max(levels["BID"], default=None), min(levels["ASK"], default=None)
        mid = None if bid is None or ask is None else (bid + ask) / 2.0
        expected.append((u, bid, ask, mid))
        if mid is not None:
            for key in [k for k in live if not mid * 0.9 <= k[1] <= mid * 1.1]:
                swept[key] = live.pop(key)
    df = spark.createDataFrame(changes, CHANGES)
    mids = book.mids(df, width)
    assert sorted((tuple(r) for r in mids.select("update_id", "best_bid", "best_ask", "mid").collect())) == expected
    kept = book.sweep_book(book.reconstruct_book(df), mids, width=width)
    assert rows(kept, "side", "price", "last_id") == sorted((*k, u) for k, u in live.items())


def test_book_at_a_grid(spark):
    df = spark.createDataFrame([("A", "SPOT", "BID", 1.0, q, i, ms) for i, (ms, q) in enumerate([(100, 1.0), (250, 2.0), (400, 0.0), (700, 3.0)])],
                               CHANGES)
    at = rows(book.book_at(df, 0, 900, 100, 1), "tick_ms", "qty")
    assert at == [(100, 1.0), (200, 1.0), (300, 2.0), (700, 3.0), (800, 3.0), (900, 3.0)]
    assert rows(book.book_at(df, 250, 450, 100), "tick_ms", "qty") == [(250, 2.0), (350, 2.0)]
