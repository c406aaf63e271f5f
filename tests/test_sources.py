from __future__ import annotations

import glob
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from depthspark import schemas
from depthspark.operators import tickers
from depthspark.session import materialize
from depthspark.sources import depth, sinks, tables
from tests.conftest import rows

RAW = "raw string, market string, recv_ms bigint"


def raw(spark, *texts):
    return spark.createDataFrame([(t, "SPOT", i) for i, t in enumerate(texts)], RAW)


def test_which_messages_are_depth(spark):
    df = raw(spark, '{"result":null,"id":1}', "ping", '{"e":"x","U":1}', '{"e":"depthUpdate","s":"BTCUSDT","U":1}', '{"e":"x","s":"open', '{"e":"x","s":"","s":"B"}')
    assert rows(depth.read_depth(df), "recv_ms", "symbol") == [(3, "BTCUSDT"), (5, "")]


def test_diffs(spark):
    df = raw(spark, '{"e":"depthUpdate","E":1704067200050,"s":"B","U":5,"u":9,"pu":4,"b":[["999.0","12.5"]],"a":[["1001.0","0"]]}',
             '{"e":"x","s":"B","U":5,"b":[]}', '{"e":"x","s":"B","u":7}', '{"e":"x","s":"B","U":1,"u":2,"b":[["oops","1"]]}', '{"e":"x","s":"B","U":1,"b":[["1"',
             '{"e":"x","s":"B","U":"many","u":2,"b":[["1"]]}').withColumn("symbol", F.lit("B"))
    got = [(r["first_id"], r["final_id"], r["prev_final_id"], r["bids"], r["asks"], r["bad"]) for r in depth.parse_diffs(df).orderBy("recv_ms").collect()]
    assert got[0] == (5, 9, 4, [(999.0, 12.5)], [(1001.0, 0.0)], False)
    assert got[1] == (5, 0, 0, [], None, False)
    assert got[2] == (0, 7, 0, None, None, False)
    assert [g[5] for g in got[3:]] == [True, True, True]
    levels = depth.explode_levels(depth.parse_diffs(df).filter("NOT bad"))
    assert rows(levels, "side", "price", "qty", "update_id", "pos") == [("ASK", 1001.0, 0.0, 9, 1), ("BID", 999.0, 12.5, 9, 0)]


def test_snapshots(spark):
    df = raw(spark, '{"lastUpdateId":7,"bids":[["999.0","10"],["998.0","0"]],"asks":[["1001.0","3"]],"more":1}', '{"code":-1003}', "nonsense").withColumn("symbol", F.lit("B"))
    one = depth.parse_snapshots(df).collect()
    assert [(r["snapshot_id"], r["bids"], r["asks"]) for r in one] == [(7, [(999.0, 10.0)], [(1001.0, 3.0)])]


def test_exchange_information_and_tickers(spark):
    futures = ('{"x":1,"symbols":[{"symbol":"AUSDT","quoteAsset":"USDT","status":"TRADING","contractType":"PERPETUAL","filters":[1]},'
               '{"symbol":"BUSDT","quoteAsset":"USDT","status":"TRADING","contractType":"CURRENT_QUARTER"},'
               '{"symbol":"CBTC","quoteAsset":"BTC","status":"TRADING","contractType":"PERPETUAL"},'
               '{"symbol":"DUSDT","quoteAsset":"USDT","status":"BREAK","contractType":"PERPETUAL"},'
               '{"symbol":"USDCUSDT","quoteAsset":"USDT","status":"TRADING","contractType":"PERPETUAL"},'
               '{"symbol":"EUSDT","quoteAsset":"USDT","status":"TRADING","contractType":"PERPETUAL"}]}')
    spot = '{"symbols":[{"symbol":"AUSDT","quoteAsset":"USDT","status":"TRADING"},{"symbol":"EUSDT","quoteAsset":"USDT","status":"BREAK"},{"symbol":"ZUSDT","quoteAsset":"USDT","status":"TRADING"}]}'
    f, s = (depth.read_exchange_info(spark.createDataFrame([(t,)], "json string")) for t in (futures, spot))
    assert s.first()["contract_type"] is None
    found = tickers.build_tickers(s, f)
    assert rows(found) == [("AUSDT", True, True), ("EUSDT", True, False)]
    assert tuple(tickers.ticker_summary(found).first()) == (2, 1, 2)
    assert [r["symbol"] for r in tickers.ticker_list(found).collect()] == ["AUSDT", "EUSDT"]


def test_tables_round_trip(spark, folder):
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
    loaded = tables.load_tables(spark, folder)
    assert {n: df.schema for n, df in loaded.items()} == {
        n: spark.createDataFrame([], ddl).schema for n, ddl in schemas.TABLES.items()}
    assert set(tables.load_tables(spark, folder, names=["plans"])) == {"plans"}


def test_connection_log_is_cut_by_day(spark, folder):
    for day in (1, 2):
        df = spark.createDataFrame([(1, "u", datetime(2026, 7, day, 12, tzinfo=timezone.utc))], "id bigint, user_id string, connected_at timestamp")
        sinks.append_connections(df, f"{folder}/connection_events")
    assert len(glob.glob(f"{folder}/connection_events/day=*")) == 2
    assert tables.load_tables(spark, folder, names=["connection_events"])["connection_events"].filter("day = '2026-07-02'").count() == 1


def test_feed_written_as_text(spark, folder):
    df = spark.createDataFrame([("DROP", "A", "SPOT")], "type string, symbol string, market string")
    assert sinks.write_feed(df, f"{folder}/feed") is None
    assert spark.read.text(f"{folder}/feed").first()[0] == '{"type":"DROP","symbol":"A","market":"SPOT"}'
    df.write.parquet(f"{folder}/in")
    query = sinks.write_feed(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), f"{folder}/stream", checkpoint=f"{folder}/c")
    query.processAllAvailable()
    query.stop()
    assert spark.read.text(f"{folder}/stream").count() == 1


def test_materialised_once(spark, folder):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert materialize(make, folder, spark).count() == materialize(make, folder, spark).count() == 3
    assert made == [1]


@pytest.mark.parametrize("body", [
    '{"bids": [["1", "2"]], "asks": [["2", "1"]]}', '{"lastUpdateId": 5, "bids": "none", "asks": [["2", "1"]]}',
    '{"lastUpdateId": 5, "bids": [["1", "2"]], "asks": [["x", "1"]]}', '{"lastUpdateId": 5, "bids": [["1"]], "asks": [["2", "1"]]}', '{"lastUpdateId": 5, "bids": [["1", "2"]]}'])
def test_a_snapshot_fails_as_a_whole(spark, body):
    good = '{"lastUpdateId": 6, "bids": [["1", "2"], ["0.5", "0"]], "asks": []}'
    raw = spark.createDataFrame([("A", "SPOT", body, 1), ("A", "SPOT", good, 2)], "symbol string, market string, raw string, recv_ms bigint")
    out = depth.parse_snapshots(raw).collect()
    assert [(r["snapshot_id"], [tuple(x) for x in r["bids"]], r["asks"]) for r in out] == [(6, [(1.0, 2.0)], [])]
    assert [r["bad"] for r in depth.read_snapshots(raw).orderBy("recv_ms").collect()] == [True, False]


def test_feed_lines_are_numbered_without_holes_and_read_back(spark, folder):
    level = "array<struct<price:double,qty:double,tier:int,first_seen_ms:bigint,distance:double>>"
    one = [(10.5, 2.0, 3, 7, 0.01), (10.25, 1e-8, 0, None, 0.025)]
    data = [("ADD", s, "SPOT", 100 * t, one, []) if t % 3 else ("DROP", s, "SPOT", 100 * t, None, None) for s in "AB" for t in range(1, 40)]
    df = spark.createDataFrame(data, f"type string, symbol string, market string, tick_ms bigint, bids {level}, asks {level}").repartition(5)
    sinks.write_feed(sinks.numbered_bodies(df, ["symbol", "market"], "tick_ms", 500), f"{folder}/feed")
    got = sorted(sinks.read_feed(spark, f"{folder}/feed").collect(), key=lambda r: (r.symbol, r.seq))
    assert [(r.symbol, r.seq, r.type) for r in got] == [(s, t, "ADD" if t % 3 else "DROP") for s in "AB" for t in range(1, 40)]
    assert all([tuple(x) for x in r.bids] == one and r.asks == [] for r in got if r.type == "ADD") and all(r.bids is None for r in got if r.type == "DROP")


def test_only_the_days_of_the_window_are_read(spark, folder):
    log = spark.range(4000).selectExpr("id", "CAST(id % 50 AS STRING) AS user_id", "timestamp_seconds(1704067200 + id * 300) AS connected_at")
    for part in (0, 1):
        sinks.append_connections(log.filter(f"id % 2 = {part}"), f"{folder}/connection_events", files_per_day=3)
    back = tables.load_tables(spark, folder, names=["connection_events"])["connection_events"]
    some = back.filter("day BETWEEN DATE '2024-01-03' AND DATE '2024-01-04'")
    assert some.count() == 576 and back.count() == 4000
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert some.select(F.input_file_name()).distinct().count() <= 2 * 2 * 3
