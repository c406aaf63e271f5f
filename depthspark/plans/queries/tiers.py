"""Tiers, top levels, activity and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthspark.operators import book, classify, rules, synced
from depthspark.plans import market
from depthspark.plans.fixtures import Tables
from depthspark.plans.queries import query
from depthspark.plans.queries.books import BANDED_SQL, SYNCED_SQL, synced_events, synced_lives
from depthspark.session import materialize


def _banded(t: Tables) -> DataFrame:
    return book.with_distance(book.reconstruct_book(t.depth_levels))


def _tiered_sql(levels: str) -> str:
    return f"""
SELECT l.*, l.price * l.qty AS notional, l.symbol IN ('BTCUSDT', 'ETHUSDT', 'SOLUSDT') AS high_liquidity,
  coalesce((SELECT max(tier_no) FROM tier_rules r WHERE r.high_liquidity = (l.symbol IN ('BTCUSDT', 'ETHUSDT', 'SOLUSDT'))
    AND l.price * l.qty >= r.min_notional AND l.distance <= r.max_distance), 0) AS tier,
  CASE WHEN l.symbol IN ('BTCUSDT', 'ETHUSDT', 'SOLUSDT') THEN 0.025e0 ELSE 0.05e0 END AS widest
FROM ({levels}) l
"""


def _top_sql(tiered: str, keys: str) -> str:
    out = "CASE WHEN side = 'BID' THEN -price ELSE price END"
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, side ORDER BY tier DESC, notional DESC, distance, {out}) AS slot
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, side ORDER BY {out}) AS depth FROM ({tiered}) t0) t1
  WHERE depth <= 5 OR distance <= widest) t2 WHERE slot <= 5
"""


_TIERED = _tiered_sql(BANDED_SQL)


# Every level change as if it stood alone: notional decides, at a distance taken from a mid of 1000.
_ALONE = """
SELECT symbol, market, side, price, qty, update_id, abs(price - 1000.0e0) / 1000.0e0 AS distance FROM depth_levels
"""


@query(f"SELECT symbol, market, update_id, high_liquidity, CAST(tier AS BIGINT) AS tier, widest FROM ({_tiered_sql(_ALONE)}) x")
def default_tier(t: Tables) -> DataFrame:
    levels = t.depth_levels.withColumn("distance", F.abs(F.col("price") - 1000.0) / 1000.0)
    return classify.default_tier(levels).select(
        "symbol", "market", "update_id", "high_liquidity", F.col("tier").cast("bigint").alias("tier"), "widest")


@query(f"SELECT symbol, market, side, price, notional, CAST(tier AS BIGINT) AS tier, widest FROM ({_TIERED}) x")
def default_rules(t: Tables) -> DataFrame:
    """The published bands as a table, applied to every live level."""
    tiered = classify.default_tier(_banded(t), classify.default_rules(t.spark))
    return tiered.select("symbol", "market", "side", "price", "notional", F.col("tier").cast("bigint").alias("tier"),
                         "widest")


@query("""
SELECT symbol, symbol IN ('BTCUSDT', 'ETHUSDT', 'SOLUSDT') AS high_liquidity, count(*) AS levels FROM depth_levels GROUP BY 1, 2
""")
def with_liquidity(t: Tables) -> DataFrame:
    return classify.with_liquidity(t.depth_levels).groupBy("symbol", "high_liquidity").agg(
        F.count("*").alias("levels"))


_USER_TIERED = """
SELECT u.user_id, l.*, l.price * l.qty AS notional, w.widest, coalesce(max(CASE WHEN l.price * l.qty >= u.min_notional AND l.distance <= u.max_distance
  THEN u.tier_no END), 0) AS tier
FROM ({levels}) l JOIN user_rules u ON l.symbol = u.symbol AND l.market = u.market
JOIN (SELECT user_id, symbol, market, max(max_distance) AS widest FROM user_rules GROUP BY 1, 2, 3) w
  ON u.user_id = w.user_id AND u.symbol = w.symbol AND u.market = w.market
GROUP BY ALL
"""


@query(f"""
SELECT user_id, symbol, market, side, price, CAST(tier AS BIGINT) AS tier, widest FROM ({_USER_TIERED.format(levels=BANDED_SQL)}) x
""")
def user_tier(t: Tables) -> DataFrame:
    tiered = classify.user_tier(_banded(t), rules.compile_rules(t.user_rules))
    return tiered.select("user_id", "symbol", "market", "side", "price", F.col("tier").cast("bigint").alias("tier"),
                         "widest")


_TOP = _top_sql(_TIERED, "symbol, market")
_TOP_COLUMNS = "symbol, market, side, price, qty, distance, notional, CAST(tier AS BIGINT) AS tier, CAST(slot AS BIGINT) AS slot"


@query(f"SELECT {_TOP_COLUMNS} FROM ({_TOP}) x")
def top_levels(t: Tables) -> DataFrame:
    top = market.top_of_books(t.depth_levels)
    return top.select("symbol", "market", "side", "price", "qty", "distance", "notional",
                      F.col("tier").cast("bigint").alias("tier"), F.col("slot").cast("bigint").alias("slot"))


def _visible_sql(top: str, keys: str) -> str:
    return f"""
SELECT {keys}, b_tier IS NOT NULL AND a_tier IS NOT NULL AND b_tier >= 1 AS bid_visible, b_tier IS NOT NULL AND a_tier IS NOT NULL AND a_tier >= 1 AS ask_visible,
  coalesce(b_tier IS NOT NULL AND a_tier IS NOT NULL AND greatest(b_tier, a_tier) >= 1, false) AS visible FROM (
  SELECT {keys}, max(CASE WHEN slot = 1 AND side = 'BID' THEN tier END) AS b_tier, max(CASE WHEN slot = 1 AND side = 'ASK' THEN tier END) AS a_tier
  FROM ({top}) t3 GROUP BY {keys}) t4
"""


@query(_visible_sql(_TOP, "symbol, market"))
def visible_books(t: Tables) -> DataFrame:
    return classify.visible_books(market.top_of_books(t.depth_levels))


# Ticks of 100 ms at which a shown book changes, its levels there, and the ticks at which it is lost.
_T = "CAST(ceil({} / 100.0e0) AS BIGINT)"
_CHANGES_SQL = SYNCED_SQL + f""",
ticks AS MATERIALIZED (SELECT symbol, market, tick, bool_or(synced) AS synced FROM (
    SELECT symbol, market, {_T.format("ms")} AS tick, true AS synced FROM changed WHERE lost_ms IS NULL OR {_T.format("ms")} < {_T.format("lost_ms")}
    UNION ALL SELECT symbol, market, {_T.format("lost_ms")}, false FROM shown WHERE lost_ms IS NOT NULL) x GROUP BY 1, 2, 3),
at_tick AS MATERIALIZED (SELECT k.symbol, k.market, k.tick, v.side, v.price, v.qty, v.first_seen_ms FROM ticks k JOIN lives v ON k.symbol = v.symbol AND k.market = v.market
    AND k.synced AND {_T.format("v.from_ms")} <= k.tick AND (v.to_ms IS NULL OR k.tick < {_T.format("v.to_ms")})),
levels AS MATERIALIZED (SELECT l.*, abs(l.price - m.mid) / m.mid AS distance, l.tick * 100 AS tick_ms FROM at_tick l JOIN (
    SELECT symbol, market, tick, (max(CASE WHEN side = 'BID' THEN price END) + min(CASE WHEN side = 'ASK' THEN price END)) / 2.0e0 AS mid FROM at_tick GROUP BY 1, 2, 3) m
    ON l.symbol = m.symbol AND l.market = m.market AND l.tick = m.tick
  WHERE l.price >= m.mid * (1.0e0 - 0.1e0) AND l.price <= m.mid * (1.0e0 + 0.1e0))
"""


def _level_text(first_seen: str = "first_seen_ms") -> str:
    return ("concat(CAST(CAST(price AS BIGINT) AS STRING), 'x', CAST(CAST(qty AS BIGINT) AS STRING), 't', "
            f"CAST(tier AS STRING), 'd', CAST(CAST(floor(distance * 1000000) AS BIGINT) AS STRING), 'f', CAST({first_seen} AS STRING))")


def _activity_sql(top: str, grid: str, keys: str) -> str:
    """Slots as text; a side's exact distances are compared as an array of doubles."""
    on = " AND ".join(f"g.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {keys}, tick_ms, CASE WHEN visible AND NOT was THEN 'ADD' WHEN NOT visible THEN 'DROP' ELSE 'UPDATE' END AS type,
  CASE WHEN visible THEN bids ELSE '' END AS bids, CASE WHEN visible THEN asks ELSE '' END AS asks FROM (
  SELECT *, lag(visible, 1, false) OVER w AS was, visible AND lag(visible, 1, false) OVER w
    AND (bids, asks, exact) IS DISTINCT FROM (lag(bids) OVER w, lag(asks) OVER w, lag(exact) OVER w) AS changed FROM (
    SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, g.tick_ms, coalesce(s.visible, false) AS visible, s.bids, s.asks, s.exact FROM ({grid}) g LEFT JOIN (
      SELECT {keys}, tick_ms, coalesce(max(CASE WHEN slot = 1 THEN tier END) >= 1 AND count(DISTINCT side) = 2, false) AS visible,
        coalesce(string_agg(CASE WHEN side = 'BID' THEN {_level_text()} END, ',' ORDER BY slot), '') AS bids,
        coalesce(string_agg(CASE WHEN side = 'ASK' THEN {_level_text()} END, ',' ORDER BY slot), '') AS asks,
        list(distance ORDER BY side, slot) AS exact
      FROM ({top}) t3 GROUP BY {keys}, tick_ms) s ON {on} AND g.tick_ms = s.tick_ms) a
  WINDOW w AS (PARTITION BY {keys} ORDER BY tick_ms)) b
WHERE visible <> was OR changed
"""


def level_texts(df: DataFrame) -> DataFrame:
    def text(side: str) -> Column:
        levels = F.transform(side, lambda x: F.concat(
            x["price"].cast("bigint").cast("string"), F.lit("x"), x["qty"].cast("bigint").cast("string"), F.lit("t"),
            x["tier"].cast("string"), F.lit("d"), F.floor(x["distance"] * 1000000).cast("bigint").cast("string"),
            F.lit("f"), x["first_seen_ms"].cast("string")))
        return F.coalesce(F.array_join(levels, ","), F.lit(""))

    return df.withColumns({"bids": text("bids"), "asks": text("asks")})


def _ticks(t: Tables) -> DataFrame:
    runs, events = synced_events(t)
    return materialize(lambda: synced.change_ticks(events, runs), f"{t.sf_dir}/change_ticks", t.spark)


ACTIVITY_SQL = _CHANGES_SQL + _activity_sql(_top_sql(_tiered_sql("SELECT * FROM levels"), "symbol, market, tick_ms"),
                                            "SELECT symbol, market, tick * 100 AS tick_ms FROM ticks", "symbol, market")


def activity(t: Tables) -> DataFrame:
    return synced.activity(synced_lives(t), _ticks(t), width=t.width)


@query(ACTIVITY_SQL)
def activity_events(t: Tables) -> DataFrame:
    return level_texts(activity(t))


@query(_CHANGES_SQL + _activity_sql(_top_sql(_USER_TIERED.format(levels="SELECT * FROM levels"), "user_id, symbol, market, tick_ms"),
                                    "SELECT r.user_id, k.symbol, k.market, k.tick * 100 AS tick_ms FROM ticks k JOIN "
                                    "(SELECT DISTINCT user_id, symbol, market FROM user_rules) r ON k.symbol = r.symbol AND k.market = r.market",
                                    "user_id, symbol, market"))
def personal_activity(t: Tables) -> DataFrame:
    return level_texts(market.personal(synced_lives(t), _ticks(t), rules.compile_rules(t.user_rules), width=t.width))


def _arrays_sql(top: str, keys: str) -> str:
    text = _level_text("-1")
    return f"""
SELECT {keys}, coalesce(max(CASE WHEN slot = 1 THEN tier END) >= 1 AND count(DISTINCT side) = 2, false) AS visible,
  coalesce(string_agg(CASE WHEN side = 'BID' THEN {text} END, ',' ORDER BY slot), '') AS bids,
  coalesce(string_agg(CASE WHEN side = 'ASK' THEN {text} END, ',' ORDER BY slot), '') AS asks FROM ({top}) t3 GROUP BY {keys}
"""


@query(f"""
SELECT 'ALL' AS scope, -1 AS user_id, symbol, market, visible, bids, asks FROM ({_arrays_sql(_TOP, "symbol, market")}) a
UNION ALL SELECT 'USER', user_id, symbol, market, visible, bids, asks FROM
  ({_arrays_sql(_top_sql(_USER_TIERED.format(levels=BANDED_SQL), "user_id, symbol, market"), "user_id, symbol, market")}) b
""")
def classify_books(t: Tables) -> DataFrame:
    everyone, personal = classify.classify(_banded(t).withColumn("first_seen_ms", F.lit(-1).cast("bigint")), rules.compile_rules(t.user_rules))
    columns = ["scope", "user_id", "symbol", "market", "visible", "bids", "asks"]
    return level_texts(everyone.withColumns({"scope": F.lit("ALL"), "user_id": F.lit(-1)}).select(*columns)
                  .unionByName(personal.withColumn("scope", F.lit("USER")).select(*columns)))


# --- rules -------------------------------------------------------------------------------------

_CHECKED = """
SELECT request_id, concat_ws(',',
    CASE WHEN bool_or(bad_distance) THEN 'BAD_DISTANCE' END, CASE WHEN bool_or(bad_notional) THEN 'BAD_NOTIONAL' END,
    CASE WHEN bool_or(bad_tier) THEN 'BAD_TIER' END, CASE WHEN bool_or(duplicate) THEN 'DUPLICATE_TIER' END,
    CASE WHEN bool_or(incomplete) THEN 'INCOMPLETE_TIERS' END, CASE WHEN bool_or(untraded) THEN 'NOT_ON_MARKET' END,
    CASE WHEN count(*) > 3 THEN 'TOO_MANY_TARGETS' END, CASE WHEN bool_or(unknown) THEN 'UNKNOWN_SYMBOL' END) AS errors
FROM (SELECT q.request_id, q.s, q.market, bool_or(max_distance <= 0 OR max_distance > 0.1e0) AS bad_distance, bool_or(min_notional < 0) AS bad_notional,
    bool_or(tier_no NOT BETWEEN 1 AND 4) AS bad_tier,
    count(*) FILTER (WHERE tier_no BETWEEN 1 AND 4) > count(DISTINCT tier_no) FILTER (WHERE tier_no BETWEEN 1 AND 4) AS duplicate,
    count(DISTINCT tier_no) FILTER (WHERE tier_no BETWEEN 1 AND 4) <> 4 OR count(*) <> 4 AS incomplete,
    bool_or(CASE WHEN q.market = 'SPOT' THEN NOT k.has_spot ELSE NOT k.has_futures END) AS untraded, bool_or(k.symbol IS NULL) AS unknown
  FROM (SELECT *, upper(trim(symbol)) AS s FROM customer_requests) q LEFT JOIN rule_tickers k ON q.s = k.symbol GROUP BY 1, 2, 3) z
GROUP BY 1
"""


@query(f"SELECT request_id, errors = '' AS ok, errors FROM ({_CHECKED}) x")
def validate_rules(t: Tables) -> DataFrame:
    checked = rules.validate_rules(t.customer_requests, t.rule_tickers, max_targets=3)
    return checked.withColumn("errors", F.array_join("errors", ","))


def _accepted(t: Tables) -> DataFrame:
    ok = rules.validate_rules(t.customer_requests, t.rule_tickers, max_targets=3).filter("ok")
    return t.customer_requests.join(ok.select("request_id"), "request_id", "left_semi")


_TIERS = "user_id, symbol, market, tier_no, min_notional, max_distance"


@query(f"""
SELECT r.user_id, r.symbol, r.market, r.tier_no, r.min_notional, r.max_distance FROM customer_rules r WHERE NOT EXISTS (
  SELECT 1 FROM customer_requests q JOIN ({_CHECKED}) c ON q.request_id = c.request_id AND c.errors = ''
  WHERE q.user_id = r.user_id AND upper(trim(q.symbol)) = r.symbol AND q.market = r.market)
UNION ALL SELECT q.user_id, upper(trim(q.symbol)), q.market, q.tier_no, q.min_notional, q.max_distance
FROM customer_requests q JOIN ({_CHECKED}) c ON q.request_id = c.request_id AND c.errors = ''
""")
def replace_rules(t: Tables) -> DataFrame:
    return rules.replace_rules(t.customer_rules, _accepted(t))


@query(f"""
SELECT {_TIERS} FROM customer_rules r WHERE NOT EXISTS (SELECT 1 FROM customer_requests q WHERE q.user_id = r.user_id AND upper(trim(q.symbol)) = r.symbol AND q.market = r.market)
""")
def delete_rules(t: Tables) -> DataFrame:
    return rules.delete_rules(t.customer_rules, t.customer_requests.select("request_id", "user_id", "symbol", "market").distinct())


_TIER_TEXT = ("concat(CAST(tier_no AS STRING), ':', CAST(CAST(min_notional AS BIGINT) AS STRING), ':', "
              "CAST(CAST(round(max_distance * 10000) AS BIGINT) AS STRING))")


def _tier_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat(
        x["tier_no"].cast("string"), F.lit(":"), x["min_notional"].cast("bigint").cast("string"), F.lit(":"),
        F.round(x["max_distance"] * 10000).cast("bigint").cast("string"))), ",")


@query(f"""
SELECT user_id, symbol, market, string_agg({_TIER_TEXT}, ',' ORDER BY tier_no) AS tiers FROM customer_rules
WHERE symbol = 'SYM2' AND market = 'SPOT' GROUP BY 1, 2, 3
""")
def list_rules(t: Tables) -> DataFrame:
    listed = rules.list_rules(t.customer_rules, symbol=" sym2", market="SPOT")
    return listed.withColumn("tiers", _tier_text("tiers"))


@query(f"""
SELECT user_id, symbol, market, string_agg({_TIER_TEXT}, ',' ORDER BY tier_no DESC) AS bands, max(max_distance) AS widest
FROM customer_rules GROUP BY 1, 2, 3
""")
def compile_rules(t: Tables) -> DataFrame:
    return rules.compile_rules(t.customer_rules).withColumn("bands", _tier_text("bands"))
