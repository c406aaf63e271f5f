from __future__ import annotations

import json
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from depthspark.functions import tiers
from depthspark.operators import book, feed
from depthspark.plans import market
from depthspark.streaming import book as stream
from depthspark.streaming import feed as windows
from tests import models
from tests.conftest import rows

RAW = "kind string, symbol string, market string, raw string, recv_ms bigint"


def story(symbol, place, seed, steps=400):
    """Raw messages of one book: diffs with gaps and bad text, snapshots at odd moments."""
    rng, out, u, now = random.Random(seed), [], 0, 1_700_000_000_000
    for _ in range(steps):
        now += rng.choice([0, 40, 60, 100])
        prev, first = u, u + 1
        u += rng.randint(1, 3)
        if rng.random() < 0.02:
            prev, first, u = prev + 7, first + 7, u + 7
        d = {"e": "depthUpdate", "s": symbol, "U": first, "u": u, "pu": prev}
        for side, low, high in (("b", 880, 999), ("a", 1001, 1120)):
            d[side] = [[f"{rng.randint(low, high)}.0", rng.choice(["0", "300.5", "9000", "60000"])]
                       for _ in range(rng.randint(0, 3))]
        out.append(("DIFF", symbol, place, json.dumps(d, separators=(",", ":")), now))
        if rng.random() < 0.08:
            snap = {"lastUpdateId": u if rng.random() < 0.8 else u + 50,
                    "bids": [[f"{p}.0", "250"] for p in range(900, 1000, 7)],
                    "asks": [[f"{p}.0", rng.choice(["0", "20000"])] for p in range(1001, 1090, 5)]}
            if rng.random() < 0.1:
                del snap["lastUpdateId"]
            out.append(("SNAPSHOT", symbol, place, json.dumps(snap), now))
    return out


def in_order(messages):
    """The arrival order the stream uses: time, diffs before snapshots, then ids."""
    def key(m):
        body = json.loads(m[3])
        return m[4], m[0] == "SNAPSHOT", body.get("u", body.get("lastUpdateId", -1))
    return sorted(messages, key=key)


def slow(messages, place):
    model, out, shown, sent = models.SlowBook(place), [], False, None
    for kind, symbol, _, text, now in in_order(messages):
        model.diff(text, now) if kind == "DIFF" else model.snapshot(text, now)
        tops = None
        if model.state == "SYNCED" and model.book["b"] and model.book["a"]:
            bands = tiers.LIQUID_BANDS if symbol in tiers.LIQUID_SYMBOLS else tiers.NORMAL_BANDS
            tops = []
            for side, back in (("b", True), ("a", False)):
                walk = [(p, model.book[side][p][0], abs(p - model.mid) / model.mid)
                        for p in sorted(model.book[side], reverse=back)]
                tops.append([(p, model.book[side][p][0], t, model.book[side][p][1], abs(p - model.mid) / model.mid)
                             for p, t in models.top_five(walk, bands)])
            if not any(side and side[0][2] >= 1 for side in tops):
                tops = None
        if tops is None and shown:
            out.append(("DROP", None))
        elif tops is not None and (not shown or tops != sent):
            out.append(("UPDATE" if shown else "ADD", tops))
        shown, sent = tops is not None, tops if tops is not None else sent
    return model, out


def replayed(messages, symbol, place):
    b = stream.Book(symbol, place)
    frame = []
    for kind, _, _, text, now in messages:
        d = json.loads(text)
        snap = kind == "SNAPSHOT"
        bids, asks = (d["bids"], d["asks"]) if snap else (d["b"], d["a"])
        frame.append((snap, d.get("U", 0), d.get("lastUpdateId", -1) if snap else d["u"], d.get("pu", 0), now,
                      snap and "lastUpdateId" not in d, True, [float(p) for p, _ in bids], [float(q) for _, q in bids],
                      [float(p) for p, _ in asks], [float(q) for _, q in asks]))
    frame = pd.DataFrame(frame, columns=["snapshot", "first_id", "final_id", "prev_final_id", "recv_ms", "bad", "has_levels",
                                         "bid_price", "bid_qty", "ask_price", "ask_qty"])
    return b, stream.replay(b, frame, False)


@pytest.mark.parametrize("seed", range(12))
def test_book_state_equals_plain_replay(seed):
    place = "SPOT" if seed % 2 else "FUTURES"
    symbol = "BTCUSDT" if seed % 3 == 0 else "ABCUSDT"
    messages = story(symbol, place, seed)
    model, expected = slow(messages, place)
    ours, events = replayed(messages, symbol, place)
    assert ours.phase == model.state
    mine = sorted((s, p, q, t) for s in ("BID", "ASK") for p, (q, t) in ours.levels[s].items())
    assert mine == model.levels()
    assert [e[2] for e in events] == [t for t, _ in expected]
    for event, (_, tops) in zip(events, expected):
        if tops is not None:
            got = [[tuple(x[c] for c in ("price", "qty", "tier", "first_seen_ms", "distance")) for x in json.loads(side)]
                   for side in event[5:]]
            assert got == tops


def test_buffer_overflow_asks_again():
    b = stream.Book("ABCUSDT", "SPOT", most_waiting=500)
    asks = [b.on_diff(stream.Message("DIFF", i, i, i - 1, i, False, True, [])) for i in range(1, 503)]
    assert asks[0] and not any(asks[1:500]) and asks[500] and not asks[501]
    assert b.phase == stream.REQUESTED and len(b.buffer) == 1


def test_distance_stays_zero_until_a_live_diff_when_literal():
    def synced(flag):
        b = stream.Book("ABCUSDT", "SPOT", compute_on_sync=flag)
        b.on_diff(stream.Message("DIFF", 5, 5, 4, 1, False, True, []))
        b.on_snapshot(stream.Message("SNAPSHOT", 0, 5, 0, 2, False, True, [("BID", 950.0, 20000.0), ("ASK", 1050.0, 1.0)]))
        return b
    assert synced(True)._tops()[0][0]["distance"] == 0.05
    assert synced(False)._tops()[0][0]["distance"] == 0.0


def run_stream(spark, folder, parts, **options):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:02d}")
    raw = (spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .parquet(f"{folder}/in"))
    query = (stream.book_stream(raw, **options).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start(f"{folder}/out"))
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_stream_over_batches_equals_replay(spark, folder):
    books = {("ABCUSDT", "SPOT"): 3, ("BTCUSDT", "FUTURES"): 4, ("XYZUSDT", "FUTURES"): 5}
    stories = {key: story(*key, seed, 200) for key, seed in books.items()}
    merged = sorted((m for s in stories.values() for m in s), key=lambda m: m[4])
    # Batches break between moments, so that arrival order is the same with and without them.
    cuts = [merged[len(merged) * i // 3][4] for i in (1, 2)]
    parts = [[m for m in merged if m[4] < cuts[0]], [m for m in merged if cuts[0] <= m[4] < cuts[1]],
             [m for m in merged if m[4] >= cuts[1]]]
    out = run_stream(spark, folder, parts)
    for (symbol, place), messages in stories.items():
        _, expected = slow(messages, place)
        got = out.filter((F.col("symbol") == symbol) & (F.col("market") == place)).collect()
        assert Counter(r["type"] for r in got) == Counter(t for t, _ in expected)
        arrays = Counter(tuple(tuple(tuple(x) for x in side) for side in (r["bids"], r["asks"])) for r in got if r["bids"])
        assert arrays == Counter(tuple(tuple(side) for side in tops) for _, tops in expected if tops)


def test_batch_book_against_streamed_book(spark):
    """Last values, sweep and band in batch against the exact replay; mids come from unswept books."""
    differing, total = 0, 0
    for seed in range(6):
        rng, changes, b = random.Random(seed), [], stream.Book("ABCUSDT", "SPOT", phase=stream.SYNCED)
        for u in range(1, 301):
            side = rng.choice(["BID", "ASK"])
            price = float(rng.randint(880, 999) if side == "BID" else rng.randint(1001, 1120))
            qty = rng.choice([0.0, 5.0, 7.0])
            changes.append(("ABCUSDT", "SPOT", side, price, qty, u, 1000 + u))
            b.on_diff(stream.Message("DIFF", u, u, u - 1, 1000 + u, False, True, [(side, price, qty)]))
        df = spark.createDataFrame(changes, "symbol string, market string, side string, price double, qty double, "
                                            "update_id bigint, recv_ms bigint")
        got = {(s, p): q for s, p, q in rows(book.book_of_record(df, width=50), "side", "price", "qty")}
        exact = {(s, p): q for s in ("BID", "ASK") for p, (q, _) in b.levels[s].items()}
        total += 1
        differing += got != exact
    print(f"{differing} of {total} random books differ")
    assert differing <= 1


def test_message_rate_and_feed_ticks_as_streams(spark, folder):
    events = [("A", "SPOT", u, 1_700_000_000_000 + u * 30, t) for u, t in
              enumerate("ADD UPDATE DROP ADD DROP ADD UPDATE UPDATE DROP ADD".split(), 1)]
    shape = "symbol string, market string, update_id bigint, recv_ms bigint, type string"
    late = [("A", "SPOT", 99, 1_700_000_900_000, "DROP")]
    spark.createDataFrame(events, shape).write.parquet(f"{folder}/in/0")
    spark.createDataFrame(late, shape).write.parquet(f"{folder}/in/1")

    def run(make, name):
        source = (spark.readStream.schema(shape).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
                  .parquet(f"{folder}/in"))
        q = (make(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/c-{name}")
             .trigger(availableNow=True).start(f"{folder}/{name}"))
        q.awaitTermination()
        return spark.read.parquet(f"{folder}/{name}")

    rate = rows(run(windows.message_rate, "rate"), "window_ms", "market", "messages")
    assert (1_700_000_000_000, "SPOT", 10) in rate
    whole = spark.createDataFrame(events, shape)
    batch = rows(feed.coalesce_ticks(whole), "tick_ms", "type", "update_id")
    assert rows(run(windows.coalesce_stream, "net"), "tick_ms", "type", "update_id") == batch


def test_late_rows_are_kept_apart(spark, folder):
    shape = "symbol string, market string, update_id bigint, recv_ms bigint"
    batches = [[("A", "SPOT", 1, 100_000), ("B", "SPOT", 2, 130_000)], [("A", "SPOT", 3, 119_999), ("A", "SPOT", 4, 120_000), ("B", "SPOT", 5, 150_000), ("B", "SPOT", 6, None)],
               [("A", "SPOT", 7, 130_000), ("B", "SPOT", 8, 139_999), ("B", "SPOT", 9, 140_000)]]
    for i, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, shape).coalesce(1).write.parquet(f"{folder}/in/{i}")
        source = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        windows.route_late(source, f"{folder}/out", f"{folder}/c", 10_000).awaitTermination()   # the query is started again for each batch
    late, on_time = (rows(spark.read.schema(shape).parquet(f"{folder}/out/{name}")) for name in (windows.LATE, windows.ON_TIME))
    assert sorted(map(str, (r[:4] for r in late + on_time))) == sorted(str(r) for part in batches for r in part)
    assert {r[2] for r in late} == {3, 6, 7, 8}
    assert rows(windows.late_counts(spark, f"{folder}/out", shape), "symbol", "late", "latest_ms") == [("A", 2, 130_000), ("B", 2, 139_999)]
    timed = spark.read.schema(shape).parquet(f"{folder}/out/{windows.ON_TIME}")
    assert windows.message_rate(timed).agg({"messages": "sum"}).first()[0] + len(late) == 9


def test_raw_messages_to_levels(spark):
    raw = spark.createDataFrame([m for m in story("ABCUSDT", "SPOT", 1, 50) if m[0] == "DIFF"], RAW)
    levels = market.depth_levels(raw.drop("symbol"))
    expected = sum(len(json.loads(m[3])["b"]) + len(json.loads(m[3])["a"]) for m in story("ABCUSDT", "SPOT", 1, 50)
                   if m[0] == "DIFF")
    assert levels.count() == expected
