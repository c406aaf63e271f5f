"""The views of FIXTURES.md over the shared test tables, for Spark and for DuckDB.

The SQL text is the definition and is what DuckDB runs. On Spark two views are built with the blocked
scans instead of one window per book, because those two would otherwise put a whole book in one task, and
the levels of snapshots with a join in buckets of ids, as each snapshot would meet every version of its book.
They and the raw messages stand for stored tables, so they are written once per session and data folder
and read from there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthspark.operators import book, dyadic, scan
from depthspark.session import materialize, stored

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
               "benchmark labels conversations").split()

VIEWS: dict[str, str] = {}
STORED = ("depth_raw", "snapshot_raw")
SNAPSHOT_IDS = 512   # ids whose versions a snapshot is compared with

VIEWS["depth_levels"] = """
SELECT symbol, market, CASE WHEN k < 120 THEN 'BID' ELSE 'ASK' END AS side, CAST(880 + k AS DOUBLE) AS price,
  CASE WHEN rm = 0 THEN CAST(0 AS DOUBLE) WHEN symbol IN ('BTCUSDT', 'ETHUSDT') THEN q * 4 ELSE q END AS qty,
  u AS update_id, 1704067200000 + u * 50 AS recv_ms
FROM (SELECT CASE l_suppkey % 8 WHEN 0 THEN 'BTCUSDT' WHEN 1 THEN 'ETHUSDT' ELSE concat('SYM', CAST(l_suppkey % 8 AS STRING)) END AS symbol,
    CASE WHEN l_linestatus = 'O' THEN 'SPOT' ELSE 'FUTURES' END AS market,
    (l_partkey * 31 + l_orderkey * 7 + l_linenumber) % 240 AS k, (l_orderkey + l_linenumber) % 17 AS rm,
    floor(l_extendedprice / 4) AS q,
    row_number() OVER (PARTITION BY l_suppkey % 8, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS u
  FROM lineitem) x
"""

VIEWS["depth_diffs"] = """
SELECT symbol, market, CASE WHEN market = 'SPOT' AND update_id % 500 = 0 THEN update_id + 5 ELSE update_id END AS first_id,
  update_id AS final_id,
  CASE WHEN market = 'FUTURES' AND update_id % 500 = 0 THEN update_id - 6 ELSE update_id - 1 END AS prev_final_id, recv_ms
FROM depth_levels
"""

VIEWS["depth_snapshots"] = """
SELECT symbol, market, update_id AS snapshot_id, recv_ms FROM depth_levels WHERE update_id % 500 = 20 OR update_id = 1
"""

# What a snapshot holds: the book of its moment, but every fifth price is missing, as it is beyond its depth.
VIEWS["snapshot_levels"] = """
SELECT v.symbol, v.market, s.snapshot_id, v.side, v.price, v.qty FROM (
  SELECT symbol, market, side, price, qty, update_id, lead(update_id) OVER (PARTITION BY symbol, market, side, price ORDER BY update_id) AS next_id FROM depth_levels) v
JOIN depth_snapshots s ON v.symbol = s.symbol AND v.market = s.market AND v.update_id <= s.snapshot_id AND (v.next_id IS NULL OR s.snapshot_id < v.next_id)
WHERE CAST(v.price AS BIGINT) % 5 <> 0
"""

VIEWS["tier_rules"] = """
SELECT * FROM (VALUES (false, 4, 10000000.0e0, 0.05e0), (false, 3, 1000000.0e0, 0.02e0), (false, 2, 500000.0e0, 0.01e0), (false, 1, 200000.0e0, 0.005e0),
  (true, 4, 100000000.0e0, 0.025e0), (true, 3, 30000000.0e0, 0.01e0), (true, 2, 10000000.0e0, 0.005e0), (true, 1, 3000000.0e0, 0.0025e0))
  AS r(high_liquidity, tier_no, min_notional, max_distance)
"""

VIEWS["user_rules"] = """
SELECT n_nationkey AS user_id, s.symbol, m.market, t.tier_no, t.min_notional * (1 + n_nationkey % 4) AS min_notional, t.max_distance
FROM nation CROSS JOIN (VALUES ('BTCUSDT', 0), ('SYM2', 1), ('SYM3', 2), ('SYM5', 3)) AS s(symbol, i)
CROSS JOIN (VALUES ('SPOT', 0), ('FUTURES', 1)) AS m(market, j) CROSS JOIN tier_rules t
WHERE NOT t.high_liquidity AND (n_nationkey + i + j) % 3 = 0
"""

VIEWS["rule_requests"] = """
SELECT user_id * 10 AS request_id, user_id, symbol, market, tier_no, min_notional,
  CASE WHEN user_id % 5 = 0 THEN 0.2e0 ELSE max_distance END AS max_distance
FROM user_rules WHERE NOT (user_id % 6 = 0 AND tier_no = 2)
"""

VIEWS["feed_events"] = """
SELECT symbol, market, update_id, recv_ms, CASE WHEN v AND p THEN 'UPDATE' WHEN v THEN 'ADD' ELSE 'DROP' END AS type
FROM (SELECT symbol, market, update_id, recv_ms, v, coalesce(lag(v) OVER (PARTITION BY symbol, market ORDER BY update_id), false) AS p
  FROM (SELECT symbol, market, update_id, recv_ms, qty > 0 AND CAST(price AS BIGINT) % 3 <> 0 AS v FROM depth_levels) a) b
WHERE v OR p
"""

VIEWS["exchange_futures"] = """
SELECT concat('P', CAST(p_partkey AS STRING)) AS symbol, CASE WHEN p_partkey % 11 = 0 THEN 'BTC' ELSE 'USDT' END AS quote_asset,
  CASE WHEN p_size % 10 = 0 THEN 'BREAK' ELSE 'TRADING' END AS status,
  CASE WHEN p_partkey % 7 = 0 THEN 'CURRENT_QUARTER' ELSE 'PERPETUAL' END AS contract_type FROM part
"""

VIEWS["exchange_spot"] = """
SELECT concat('P', CAST(p_partkey AS STRING)) AS symbol, CASE WHEN p_partkey % 13 = 0 THEN 'BTC' ELSE 'USDT' END AS quote_asset,
  CASE WHEN p_size % 8 = 0 THEN 'BREAK' ELSE 'TRADING' END AS status, CAST(NULL AS STRING) AS contract_type
FROM part WHERE p_partkey % 3 <> 0
"""

VIEWS["connection_events"] = """
SELECT event_id AS id, user_id, ts AS connected_at FROM events
"""

# A log over seven years.
VIEWS["order_log"] = """
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS connected_at FROM orders
"""

VIEWS["sessions"] = """
SELECT event_id AS session_id, user_id, 1704067200 + event_id * 259 AS opened_s,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 1704067200 + event_id * 259 + 60 + (event_id * 37) % 40000 END AS closed_s FROM events
"""

VIEWS["users"] = """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' ELSE 'USER' END AS role, c_name AS name,
  788918400 + c_custkey * 86400 AS created_s FROM customer
"""

# Users with e-mail addresses, some of them twice or missing, and the ledger with the admin behind a grant.
VIEWS["accounts"] = """
SELECT user_id, role, CASE WHEN user_id % 71 = 0 THEN CAST(NULL AS STRING) WHEN user_id % 53 = 0 THEN 'same@example.org' ELSE concat('u', CAST(user_id - user_id % 97 % 2 AS STRING), '@example.org') END AS email FROM users
"""

VIEWS["ledger"] = """
SELECT order_id + CASE WHEN order_id % 43 = 0 THEN 100000000 ELSE 0 END AS order_id, CASE WHEN order_id % 59 = 0 THEN CAST(NULL AS BIGINT) ELSE user_id END AS user_id, source, granted_seconds,
  CASE WHEN source = 'ADMIN' THEN CASE WHEN order_id % 37 = 0 THEN -user_id ELSE user_id END END AS admin_id FROM grants
"""

VIEWS["plans"] = """
SELECT * FROM (VALUES ('weekly', 'FIXED', 7, true), ('monthly', 'FIXED', 30, true), ('yearly', 'FIXED', 365, false),
  ('pay_as_you_go', 'PER_DAY', CAST(NULL AS INT), true)) AS p(code, type, duration_days, active)
"""

VIEWS["plan_prices"] = """
SELECT * FROM (VALUES ('weekly', 'UZS', 5000000, true), ('monthly', 'UZS', 15000000, true), ('monthly', 'USD', 1500, false),
  ('yearly', 'UZS', 150000000, true), ('pay_as_you_go', 'UZS', 800000, true)) AS q(code, currency, amount_minor, active)
"""

VIEWS["grants"] = """
SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS granted_at,
  CAST(86400 * (1 + o_orderkey % 30) AS BIGINT) AS granted_seconds,
  CASE o_orderkey % 3 WHEN 0 THEN 'TRIAL' WHEN 1 THEN 'PURCHASE' ELSE 'ADMIN' END AS source FROM orders
"""

VIEWS["pay_orders"] = """
SELECT o_orderkey AS order_id, o_custkey AS user_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'PAID' WHEN 2 THEN 'EXPIRED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'CANCELED' WHEN 5 THEN 'REVERTED' ELSE 'PENDING' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'yearly' ELSE 'pay_as_you_go' END AS plan_code,
  CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat('pu-', CAST(o_orderkey AS STRING)) END AS provider_uuid,
  1704067200 + (o_orderkey * 53) % 3600 AS expires_s, 1704060000 + o_orderkey AS created_s FROM orders
"""

VIEWS["provider_payments"] = """
SELECT concat('pu-', CAST(o_orderkey AS STRING)) AS provider_uuid,
  CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 37 = 0 THEN NULL
    ELSE CASE o_orderkey % 9 WHEN 0 THEN 'error' WHEN 1 THEN 'revert' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'draft' WHEN 4 THEN 'mystery' WHEN 5 THEN NULL ELSE 'success' END END AS raw_status,
  CASE WHEN o_orderkey % 17 = 0 THEN 'ERROR_NOT_FOUND' WHEN o_orderkey % 37 = 0 THEN 'TIMEOUT' ELSE NULL END AS error_code,
  CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS total_minor
FROM orders WHERE o_orderkey % 41 <> 0
"""

VIEWS["callbacks"] = """
SELECT order_id AS callback_id, 'store-1' AS store_id, CAST(order_id AS STRING) AS invoice_id,
  CASE WHEN order_id % 23 = 0 THEN concat('pu-x', CAST(order_id AS STRING)) ELSE concat('pu-', CAST(order_id AS STRING)) END AS uuid,
  amount_minor + CASE WHEN order_id % 13 = 0 THEN 1 ELSE 0 END AS amount,
  CASE WHEN order_id % 31 = 0 THEN '10.0.0.9' ELSE '10.0.0.1' END AS source_ip,
  md5(concat('store-1', CAST(order_id AS STRING), CAST(amount_minor + CASE WHEN order_id % 13 = 0 THEN 1 ELSE 0 END AS STRING),
    CASE WHEN order_id % 19 = 0 THEN 'wrong-key' ELSE 'fixture-key' END)) AS sign
FROM pay_orders
"""

# Callbacks and provider answers as they came in over time; some callbacks are sent again, and orders are swept twice.
VIEWS["callback_log"] = """
SELECT callback_id * 2 AS callback_id, store_id, invoice_id, uuid, amount, source_ip, sign, 1704067200 + (callback_id * 31) % 7200 AS at_s FROM callbacks
UNION ALL SELECT callback_id * 2 + 1, store_id, invoice_id, uuid, amount, source_ip, sign, 1704067200 + (callback_id * 31) % 7200 + (callback_id % 3) * 900 FROM callbacks WHERE callback_id % 4 < 2
"""

VIEWS["sweep_log"] = """
SELECT concat(provider_uuid, '-1') AS sweep_id, provider_uuid, raw_status, error_code, total_minor, 1704067200 + (CAST(substr(provider_uuid, 4) AS BIGINT) * 17) % 7200 AS at_s FROM provider_payments
UNION ALL SELECT concat(provider_uuid, '-2'), provider_uuid, CASE WHEN raw_status = 'draft' THEN 'success' ELSE raw_status END, CAST(NULL AS STRING), total_minor,
  1704067200 + (CAST(substr(provider_uuid, 4) AS BIGINT) * 17) % 7200 + 3000 FROM provider_payments
"""

VIEWS["status_history"] = """
SELECT order_id, seq, CASE (order_id + seq * 3) % 7 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PAID' WHEN 3 THEN 'EXPIRED' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'CANCELED' ELSE 'REVERTED' END AS to_status,
  CASE WHEN (order_id + seq) % 3 = 0 THEN NULL ELSE 'PROVIDER_ERROR' END AS reason
FROM (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS seq FROM lineitem) x
"""

# Raw exchange messages written from the same rows: one diff per level change, and acks, short
# frames and messages without a symbol mixed in.
VIEWS["depth_raw"] = """
SELECT market, recv_ms, update_id AS n,
  CASE WHEN update_id % 97 = 0 THEN concat('{"result":null,"id":', CAST(update_id AS STRING), '}')
    WHEN update_id % 89 = 0 THEN 'ping'
    WHEN update_id % 83 = 0 THEN concat('{"e":"depthUpdate","U":', CAST(update_id AS STRING), '}')
    ELSE concat('{"e":"depthUpdate","E":', CAST(recv_ms AS STRING), ',"s":"', symbol, '","U":', CAST(update_id AS STRING),
      ',"u":', CAST(update_id AS STRING), ',"pu":', CAST(update_id - 1 AS STRING), ',"b":[',
      CASE WHEN side = 'BID' THEN concat('["', CAST(CAST(price AS BIGINT) AS STRING), '.5","', CAST(CAST(qty AS BIGINT) AS STRING), '.25"],["',
        CAST(CAST(price AS BIGINT) - 1 AS STRING), '.5","0"]') ELSE '' END, '],"a":[',
      CASE WHEN side = 'ASK' THEN concat('["', CAST(CAST(price AS BIGINT) AS STRING), '.5","', CAST(CAST(qty AS BIGINT) AS STRING), '.25"]') ELSE '' END,
      ']}') END AS raw
FROM depth_levels
"""

VIEWS["snapshot_raw"] = """
SELECT symbol, market, recv_ms, CASE WHEN update_id % 7 = 0 THEN '{"code":-1003,"msg":"busy"}'
    WHEN update_id % 11 = 0 THEN concat('{"lastUpdateId":', CAST(update_id AS STRING), ',"bids":[["900.0","2"],["x","1"]],"asks":[["1000.0","3"]]}')
    WHEN update_id % 13 = 0 THEN concat('{"lastUpdateId":', CAST(update_id AS STRING), ',"bids":[["900.0","2"]],"asks":[["1000.0","three"]]}')
    WHEN update_id % 17 = 0 THEN concat('{"lastUpdateId":', CAST(update_id AS STRING), ',"bids":[["900.0","2"]],"asks":"none"}')
    ELSE concat('{"lastUpdateId":', CAST(update_id AS STRING), ',"bids":[["', CAST(CAST(price AS BIGINT) - 40 AS STRING), '.0","',
      CAST(CAST(qty AS BIGINT) AS STRING), '.5"]],"asks":[["', CAST(CAST(price AS BIGINT) + 260 AS STRING), '.0","3"],["2000.0","0"]]}') END AS raw
FROM depth_levels WHERE update_id % 20 = 1
"""

VIEWS["exchange_raw"] = """
SELECT concat('{"timezone":"UTC","symbols":[{"symbol":"', symbol, '","quoteAsset":"', quote_asset, '","status":"', status,
  '","contractType":"', contract_type, '","filters":[]},{"symbol":"', symbol, 'X","quoteAsset":"', quote_asset,
  '","status":"', status, '"}]}') AS json
FROM exchange_futures
"""

# Symbols the rule requests may name, by market.
VIEWS["rule_tickers"] = """
SELECT * FROM (VALUES ('BTCUSDT', true, true), ('SYM2', true, true), ('SYM3', true, false), ('SYM4', true, true))
  AS t(symbol, has_futures, has_spot)
"""

# Short feed sessions, several open at any moment of the depth data.
VIEWS["feed_sessions"] = """
SELECT event_id AS session_id, user_id % 40 AS user_id, 1704067200000 + event_id * 18 AS opened_ms,
  1704067200000 + event_id * 18 + 20 + (event_id * 37) % 150 AS closed_ms FROM events
"""

# Sessions that stay open for a day, or have no end yet; some opened long before the first event.
VIEWS["long_sessions"] = """
SELECT event_id AS session_id, user_id % 40 AS user_id, 1704067200000 + (event_id * 7919) % 150000 - CASE WHEN event_id % 2 = 0 THEN 43200000 ELSE 0 END AS opened_ms,
  CASE WHEN event_id % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE 1704067200000 + (event_id * 7919) % 150000 + 43200000 END AS closed_ms FROM events WHERE event_id % 400 = 7 OR event_id % 800 = 10
"""

VIEWS["resnapshot_requests"] = """
SELECT event_id AS session_id, 1704067200000 + event_id * 18 + 60 AS asked_ms FROM events WHERE event_type = 'error'
"""

VIEWS["rule_changes"] = """
SELECT event_id AS change_id, user_id, 1704067200 + event_id * 259 AS changed_s, event_id % 4 <> 0 AS had_rules,
  event_id % 3 <> 0 AS has_rules FROM events
"""

# Money as text, so that all digits survive: some amounts have too many decimals, some codes are bad.
VIEWS["quote_requests"] = """
SELECT o_orderkey AS request_id,
  CASE o_orderkey % 11 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' WHEN 2 THEN 'US' WHEN 3 THEN ' uzs ' WHEN 4 THEN 'BTC' WHEN 5 THEN 'eth' ELSE 'UZS' END AS currency,
  CASE WHEN o_orderkey % 13 = 0 THEN concat(CAST(o_orderkey AS STRING), '.125')
    WHEN o_orderkey % 17 = 0 THEN concat(CAST(o_orderkey AS STRING), '.500000000')
    WHEN o_orderkey % 19 = 0 THEN '0.00' WHEN o_orderkey % 23 = 0 THEN '-5.00'
    WHEN o_orderkey % 29 = 0 THEN '8000.000000000000000001'
    ELSE concat(CAST(o_orderkey % 100000 AS STRING), '.', CAST(10 + o_orderkey % 90 AS STRING)) END AS amount_text
FROM orders
"""

VIEWS["gift_requests"] = """
SELECT o_orderkey AS request_id, o_custkey AS user_id, 1 + o_orderkey % 5 AS days FROM orders
UNION ALL SELECT o_orderkey, o_custkey, 1 + o_orderkey % 5 FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, o_custkey + 7, 1 + o_orderkey % 5 FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, -o_custkey, 1 + o_orderkey % 5 FROM orders WHERE o_orderkey % 10 = 0
"""

# Success signals: callbacks that passed, and sweep findings, with repeats.
VIEWS["success_signals"] = """
SELECT order_id * 2 AS signal_id, order_id, 'CALLBACK' AS source, 1704070800 + (order_id * 31) % 900 AS at_s FROM pay_orders WHERE order_id % 3 <> 0
UNION ALL SELECT order_id * 2 + 1, order_id, 'RECONCILIATION', 1704070800 + (order_id * 17) % 900 FROM pay_orders WHERE order_id % 5 <> 0
"""

VIEWS["order_requests"] = """
SELECT o_orderkey AS request_id, o_custkey AS user_id, CASE WHEN o_orderkey % 6 = 0 THEN 'CANCEL' ELSE 'CREATE' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'weekly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'yearly' WHEN 3 THEN 'pay_as_you_go' ELSE 'gold' END AS plan_code,
  CASE WHEN o_orderkey % 8 = 0 THEN 'USD' ELSE 'UZS' END AS currency,
  CASE WHEN o_orderkey % 7 = 0 THEN -500 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS amount_minor, o_orderkey AS asked_s FROM orders
"""

# One current expiry per user, in whole seconds, around the fixed point in time of the queries.
VIEWS["entitlements"] = """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 1704067200 + (c_custkey * 7919) % 1728000 - 864000 END AS expires_s,
  c_custkey % 4 = 0 AS has_paid FROM customer WHERE c_custkey % 12 <> 5
"""

# A plan catalogue, rules and rule requests that grow with the data.
VIEWS["catalog_plans"] = """
SELECT concat('plan-', CAST(p_partkey AS STRING)) AS code, CASE WHEN p_partkey % 5 = 0 THEN 'PER_DAY' ELSE 'FIXED' END AS type,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(NULL AS INT) ELSE 7 + p_size END AS duration_days, p_partkey % 4 <> 0 AS active FROM part
"""

VIEWS["catalog_prices"] = """
SELECT concat('plan-', CAST(p_partkey AS STRING)) AS code, 'UZS' AS currency, CAST(round(p_retailprice * 100) AS BIGINT) AS amount_minor,
  p_partkey % 3 <> 0 AS active FROM part
UNION ALL SELECT concat('plan-', CAST(p_partkey AS STRING)), 'USD', CAST(round(p_retailprice) AS BIGINT), p_partkey % 6 <> 0 FROM part WHERE p_partkey % 2 = 0
"""

VIEWS["customer_rules"] = """
SELECT c_custkey AS user_id, s.symbol, m.market, t.tier_no, t.min_notional * (1 + c_custkey % 4) AS min_notional, t.max_distance
FROM customer CROSS JOIN (VALUES ('BTCUSDT', 0), ('SYM2', 1), ('SYM3', 2), ('SYM5', 3)) AS s(symbol, i)
CROSS JOIN (VALUES ('SPOT', 0), ('FUTURES', 1)) AS m(market, j) CROSS JOIN tier_rules t
WHERE NOT t.high_liquidity AND (c_custkey + i + j) % 3 = 0
"""

VIEWS["customer_requests"] = """
SELECT user_id * 10 + CASE WHEN symbol = 'BTCUSDT' THEN 0 ELSE 1 END AS request_id, user_id,
  CASE WHEN user_id % 4 = 1 THEN concat(' ', lower(symbol)) ELSE symbol END AS symbol, market,
  CASE WHEN user_id % 11 = 0 AND tier_no = 4 THEN 3 WHEN user_id % 17 = 0 AND tier_no = 1 THEN 9 ELSE tier_no END AS tier_no,
  CASE WHEN user_id % 13 = 0 THEN -1.0e0 ELSE min_notional * 2 END AS min_notional,
  CASE WHEN user_id % 5 = 0 THEN 0.2e0 ELSE max_distance END AS max_distance
FROM customer_rules WHERE NOT (user_id % 6 = 0 AND tier_no = 2)
"""

# Order steps with the state they start from, which does not always fit the step before.
VIEWS["status_steps"] = """
SELECT order_id, seq, to_status, reason, CASE WHEN seq = 1 THEN NULL WHEN (order_id + seq) % 9 = 0 THEN to_status ELSE
  CASE (order_id + (seq - 1) * 3 + CASE WHEN order_id % 10 = 0 THEN 1 ELSE 0 END) % 7 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PAID'
    WHEN 3 THEN 'EXPIRED' WHEN 4 THEN 'FAILED' WHEN 5 THEN 'CANCELED' ELSE 'REVERTED' END END AS from_status
FROM status_history
"""

_NAME = re.compile(r"\b(FROM|JOIN)\s+([a-z_]+)\b")


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(m.group(2) for m in _NAME.finditer(sql)))


def duckdb_sql(sql: str) -> str:
    """The statement with every view it needs put in front as a common table expression."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in VIEWS or name in ordered:
            return
        for inner in _names(VIEWS[name]):
            need(inner)
        ordered.append(name)

    for name in _names(sql):
        need(name)
    body = sql.strip()
    if not ordered:
        return body
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    for start in ("WITH RECURSIVE", "WITH"):
        if body.startswith(start):
            return f"{start} {views},\n{body[len(start):].strip()}"
    return f"WITH {views}\n{body}"


class Tables:
    """Spark side of the views for one data folder; each view is planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str, width: int = scan.WIDTH):
        self.spark, self.sf_dir, self.width = spark, sf_dir, width
        self._made: dict[str, DataFrame] = {}
        self._special: dict[str, Callable[[], DataFrame]] = {
            "depth_levels": self._depth_levels, "feed_events": self._feed_events, "snapshot_levels": self._snapshot_levels}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in BASE_TABLES):
            raise AttributeError(name)
        if name not in self._made:
            if name in self._special:
                self._made[name] = materialize(self._special[name], f"{self.sf_dir}/{name}", self.spark)
            elif name in STORED:
                self._made[name] = materialize(lambda: self.sql(VIEWS[name]), f"{self.sf_dir}/{name}", self.spark)
            elif name in VIEWS:
                self._made[name] = self.sql(VIEWS[name])
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        inputs = {n: getattr(self, n) for n in _names(text) if n in VIEWS or n in BASE_TABLES}
        marked = _NAME.sub(
            lambda m: f"{m.group(1)} {{{m.group(2)}}}" if m.group(2) in inputs else m.group(0),
            text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(marked, **inputs)

    def _depth_levels(self) -> DataFrame:
        keyed = self.lineitem.withColumns({"book": F.col("l_suppkey") % 8})
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
                 "l_quantity"]
        numbered = scan.row_numbers(keyed.select("book", "l_linestatus", *order), ["book", "l_linestatus"],
                                    order, "u", 2 * self.width)
        k = (F.col("l_partkey") * 31 + F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 240
        base_qty = F.floor(F.col("l_extendedprice") / 4).cast("double")
        symbol = (F.when(F.col("book") == 0, "BTCUSDT").when(F.col("book") == 1, "ETHUSDT")
                  .otherwise(F.concat(F.lit("SYM"), F.col("book").cast("string"))))
        deleted = (F.col("l_orderkey") + F.col("l_linenumber")) % 17 == 0
        return numbered.select(
            symbol.alias("symbol"),
            F.when(F.col("l_linestatus") == "O", "SPOT").otherwise("FUTURES").alias("market"),
            F.when(k < 120, "BID").otherwise("ASK").alias("side"),
            (880 + k).cast("double").alias("price"),
            F.when(deleted, F.lit(0.0)).when(F.col("book") < 2, base_qty * 4).otherwise(base_qty).alias("qty"),
            F.col("u").alias("update_id"),
            (1704067200000 + F.col("u") * 50).alias("recv_ms"))

    def _feed_events(self) -> DataFrame:
        shown = self.depth_levels.select(
            "symbol", "market", "update_id", "recv_ms",
            ((F.col("qty") > 0) & (F.col("price").cast("bigint") % 3 != 0)).alias("v"))
        seen = scan.previous(shown, ["symbol", "market"], ["update_id"], ["v"], self.width)
        before = F.coalesce("prev_v", F.lit(False))
        return (seen.filter(F.col("v") | before)
                .select("symbol", "market", "update_id", "recv_ms",
                        F.when(F.col("v") & before, "UPDATE").when(F.col("v"), "ADD").otherwise("DROP")
                        .alias("type")))

    def _snapshot_levels(self) -> DataFrame:
        kept = self.depth_levels.filter(F.col("price").cast("bigint") % 5 != 0).withColumn("__back", -F.col("update_id"))
        held = stored(scan.previous(kept, book.LEVEL, ["__back"], ["update_id"], self.width * book.LEVEL_STRETCH, prefix="next_")
                      .select(*book.LEVEL, "qty", "update_id", "next_update_id"))
        asked = self.depth_snapshots.select(*book.BOOK, "snapshot_id")
        met = dyadic.dyadic_join(asked, held, book.BOOK, "snapshot_id", "update_id", "next_update_id", SNAPSHOT_IDS,
                                 asked.select(F.max("snapshot_id")).scalar())
        return met.select("symbol", "market", "snapshot_id", "side", "price", "qty")
