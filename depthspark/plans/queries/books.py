"""Sequence, sync, books at a moment and over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthspark.operators import book, synced
from depthspark.plans.fixtures import Tables
from depthspark.plans.queries import query
from depthspark.session import materialize

START_MS = 1704067200000
AS_OF_MS = START_MS + 10_000_000

_GAPS = """
SELECT symbol, market, first_id, final_id, recv_ms, prev_id, coalesce(CASE WHEN market = 'SPOT' THEN first_id <> prev_id + 1
    ELSE prev_final_id <> prev_id END, false) AS is_gap
FROM (SELECT *, lag(final_id) OVER (PARTITION BY symbol, market ORDER BY recv_ms, final_id) AS prev_id FROM depth_diffs) x
"""
_RUNS = f"""
SELECT *, CAST(sum(CASE WHEN is_gap THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, market ORDER BY recv_ms, final_id) AS BIGINT) AS segment FROM ({_GAPS}) g
"""
# Each snapshot against the diffs of the run it arrives in.
_SYNC = f"""
SELECT s.symbol, s.market, s.snapshot_id, s.recv_ms, s.segment,
  CASE WHEN min(d.final_id) IS NOT NULL AND arg_min(d.first_id, d.final_id) <= s.snapshot_id THEN min(d.final_id) END AS sync_id
FROM (SELECT p.symbol, p.market, p.snapshot_id, p.recv_ms, max(r.segment) AS segment FROM depth_snapshots p
    LEFT JOIN ({_RUNS}) r ON p.symbol = r.symbol AND p.market = r.market AND r.recv_ms <= p.recv_ms GROUP BY 1, 2, 3, 4) s
LEFT JOIN ({_RUNS}) d ON s.symbol = d.symbol AND s.market = d.market AND s.segment = d.segment AND NOT d.is_gap
  AND d.recv_ms <= s.recv_ms AND d.final_id >= s.snapshot_id
GROUP BY 1, 2, 3, 4, 5
"""


def _states_sql(sync: str) -> str:
    return f"""
SELECT r.symbol, r.market, r.segment, CASE WHEN r.final_id >= f.sync_id THEN 'SYNCED' WHEN r.is_gap THEN 'PENDING' ELSE 'SNAPSHOT_REQUESTED' END AS state,
  min(r.final_id) AS from_id, max(r.final_id) AS to_id, min(r.recv_ms) AS from_ms, max(r.recv_ms) AS to_ms
FROM ({_RUNS}) r LEFT JOIN (SELECT symbol, market, segment, arg_min(sync_id, recv_ms) AS sync_id FROM ({sync}) y
    WHERE sync_id IS NOT NULL GROUP BY 1, 2, 3) f ON r.symbol = f.symbol AND r.market = f.market AND r.segment = f.segment
GROUP BY 1, 2, 3, 4
"""


def _now_sql(states: str, as_of_ms: int | str) -> str:
    return f"""
SELECT symbol, market, arg_max(state, from_ms) AS state, max(from_ms) AS since_ms FROM ({states}) z
WHERE from_ms <= {as_of_ms} GROUP BY 1, 2
"""


_STATES = _states_sql(_SYNC)


@query(f"SELECT symbol, market, first_id, final_id, coalesce(prev_id, -1) AS prev_id, is_gap FROM ({_GAPS}) g")
def sequence_gaps(t: Tables) -> DataFrame:
    gaps = book.sequence_gaps(t.depth_diffs, t.width)
    return gaps.select("symbol", "market", "first_id", "final_id",
                       F.coalesce("prev_id", F.lit(-1)).alias("prev_id"), "is_gap")


def _runs(t: Tables) -> DataFrame:
    # Read two or three times below, so it is written once, as the operators expect of a long log.
    return materialize(lambda: book.with_segments(t.depth_diffs, t.width), f"{t.sf_dir}/runs", t.spark)


def _sync(t: Tables) -> DataFrame:
    return book.sync_points(t.depth_snapshots, _runs(t), t.width)


def _states(t: Tables) -> DataFrame:
    return book.sync_segments(_runs(t), _sync(t))


@query(f"""
SELECT symbol, market, snapshot_id, coalesce(sync_id, -1) AS sync_id, CASE WHEN sync_id IS NULL THEN 'RESYNC' ELSE 'SYNCED' END AS status
FROM ({_SYNC}) y
""")
def sync_points(t: Tables) -> DataFrame:
    return _sync(t).select("symbol", "market", "snapshot_id",
                           F.coalesce("sync_id", F.lit(-1)).alias("sync_id"), "status")


@query(_STATES)
def sync_segments(t: Tables) -> DataFrame:
    return _states(t)


@query(f"SELECT market, count(*) AS synced FROM ({_now_sql(_STATES, AS_OF_MS)}) n WHERE state = 'SYNCED' GROUP BY market")
def sync_counts(t: Tables) -> DataFrame:
    return book.sync_counts(_states(t), AS_OF_MS)


# Snapshots came for some of the symbols only; the other books wait since their last break.
_SERVED = ("BTCUSDT", "SYM2", "SYM4", "SYM7")
_WAITING = _now_sql(_states_sql(f"SELECT * FROM ({_SYNC}) s WHERE symbol IN {_SERVED}"), AS_OF_MS)


@query(f"""
SELECT market, symbol, since_ms AS waiting_since, row_number() OVER (PARTITION BY market ORDER BY since_ms, symbol) <= 3 AS admitted
FROM ({_WAITING}) x WHERE state = 'SNAPSHOT_REQUESTED'
""")
def snapshot_backlog(t: Tables) -> DataFrame:
    served = _sync(t).filter(F.col("symbol").isin(*_SERVED))
    return book.snapshot_backlog(book.sync_segments(_runs(t), served), AS_OF_MS, limit=3)


# --- synced runs ---------------------------------------------------------------------------------

# The first good snapshot of each run, its levels, the changes after it, and what becomes of each level.
SYNCED_SQL = f"""
WITH runs AS MATERIALIZED ({_RUNS}), sync AS MATERIALIZED ({_SYNC}),
shown AS MATERIALIZED (SELECT g.*, e.end_id, n.lost_ms FROM (
    SELECT symbol, market, segment, min(recv_ms) AS snap_ms, arg_min(snapshot_id, recv_ms) AS snapshot_id, arg_min(sync_id, recv_ms) AS sync_id
    FROM sync WHERE sync_id IS NOT NULL GROUP BY 1, 2, 3) g
  JOIN (SELECT symbol, market, segment, max(final_id) AS end_id FROM runs WHERE NOT is_gap GROUP BY 1, 2, 3) e USING (symbol, market, segment)
  LEFT JOIN (SELECT symbol, market, segment - 1 AS segment, min(recv_ms) AS lost_ms FROM runs GROUP BY 1, 2, 3) n USING (symbol, market, segment)),
changed AS MATERIALIZED (
  SELECT r.symbol, r.market, r.segment, l.side, l.price, l.qty, l.update_id, 1 AS pos, greatest(l.recv_ms, r.snap_ms) AS ms, r.lost_ms, false AS load
  FROM depth_levels l JOIN shown r ON l.symbol = r.symbol AND l.market = r.market AND l.update_id BETWEEN r.sync_id AND r.end_id
  UNION ALL SELECT r.symbol, r.market, r.segment, s.side, s.price, s.qty, r.sync_id, 0, r.snap_ms, r.lost_ms, true
  FROM snapshot_levels s JOIN shown r ON s.symbol = r.symbol AND s.market = r.market AND s.snapshot_id = r.snapshot_id WHERE s.qty > 0),
ahead AS MATERIALIZED (SELECT *, lead(update_id) OVER w AS next_id, lead(ms) OVER w AS next_ms, lead(qty) OVER w AS next_qty FROM changed
  WINDOW w AS (PARTITION BY symbol, market, segment, side, price ORDER BY update_id, pos)),
run_mids AS MATERIALIZED (SELECT d.symbol, d.market, d.segment, d.update_id, d.ms,
    (max(CASE WHEN v.side = 'BID' THEN v.price END) + min(CASE WHEN v.side = 'ASK' THEN v.price END)) / 2.0e0 AS mid
  FROM (SELECT DISTINCT symbol, market, segment, update_id, ms FROM changed) d JOIN ahead v ON d.symbol = v.symbol AND d.market = v.market AND d.segment = v.segment
    AND v.qty > 0 AND v.update_id <= d.update_id AND (v.next_id IS NULL OR d.update_id < v.next_id) GROUP BY 1, 2, 3, 4, 5),
swept AS MATERIALIZED (SELECT v.symbol, v.market, v.segment, v.side, v.price, v.update_id, v.pos, min(m.ms) AS swept_ms, min(m.update_id) AS swept_id
  FROM ahead v JOIN run_mids m ON v.symbol = m.symbol AND v.market = m.market AND v.segment = m.segment AND v.qty > 0
    AND v.update_id <= m.update_id AND (v.next_id IS NULL OR m.update_id < v.next_id)
  WHERE v.price < m.mid * (1.0e0 - 0.1e0) OR v.price > m.mid * (1.0e0 + 0.1e0) GROUP BY 1, 2, 3, 4, 5, 6, 7),
lives AS MATERIALIZED (SELECT symbol, market, segment, side, price, qty, update_id, ms AS from_ms, least(next_ms, swept_ms, lost_ms) AS to_ms, next_qty, next_ms, swept_ms, lost_ms, why,
    max(CASE WHEN why IS NOT NULL THEN ms END) OVER (PARTITION BY symbol, market, segment, side, price ORDER BY update_id, pos ROWS UNBOUNDED PRECEDING) AS first_seen_ms
  FROM (SELECT a.*, s.swept_ms, CASE WHEN a.load THEN 'LOAD' WHEN lag(a.qty) OVER w IS NULL THEN 'NEW' WHEN lag(a.qty) OVER w = 0 THEN 'DELETED'
      WHEN lag(s.swept_ms) OVER w IS NOT NULL THEN 'SWEPT' END AS why
    FROM ahead a LEFT JOIN swept s ON a.symbol = s.symbol AND a.market = s.market AND a.segment = s.segment AND a.side = s.side AND a.price = s.price
      AND a.update_id = s.update_id AND a.pos = s.pos WINDOW w AS (PARTITION BY a.symbol, a.market, a.segment, a.side, a.price ORDER BY a.update_id, a.pos)) x WHERE qty > 0)
"""


def synced_events(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Shown runs and the level events in them; the events are written once, as they are read several times."""
    runs = materialize(lambda: synced.shown_runs(_runs(t), _sync(t)), f"{t.sf_dir}/shown_runs", t.spark)
    events = materialize(lambda: synced.level_events(t.depth_levels, t.snapshot_levels, _runs(t), runs), f"{t.sf_dir}/synced_events", t.spark)
    return runs, events


def synced_lives(t: Tables) -> DataFrame:
    return materialize(lambda: synced.level_lives(synced_events(t)[1], width=t.width), f"{t.sf_dir}/synced_lives", t.spark)


@query(SYNCED_SQL + "SELECT symbol, market, segment, snapshot_id, snap_ms, sync_id, end_id, coalesce(lost_ms, -1) AS lost_ms FROM shown")
def shown_runs(t: Tables) -> DataFrame:
    return synced_events(t)[0].withColumn("lost_ms", F.coalesce("lost_ms", F.lit(-1)))


@query(SYNCED_SQL + """
SELECT symbol, market, segment, side, price, qty, update_id, from_ms, coalesce(to_ms, -1) AS to_ms, first_seen_ms,
  coalesce(CASE WHEN to_ms IS NULL THEN NULL WHEN swept_ms = to_ms THEN 'SWEPT' WHEN next_ms = to_ms THEN CASE WHEN next_qty > 0 THEN 'SET' ELSE 'DELETED' END ELSE 'LOST' END, 'LIVE') AS ended
FROM lives
""")
def first_seen_restarts(t: Tables) -> DataFrame:
    """Each level's life over synced runs; first seen anew after a delete, a sweep and a load."""
    return synced_lives(t).withColumns({"to_ms": F.coalesce("to_ms", F.lit(-1)), "ended": F.coalesce("ended", F.lit("LIVE"))})


def _live_sql(changes: str) -> str:
    return f"""
SELECT symbol, market, side, price, arg_max(qty, update_id) AS qty, max(update_id) AS last_id FROM {changes if changes.isidentifier() else f"({changes}) c"}
GROUP BY 1, 2, 3, 4 HAVING arg_max(qty, update_id) > 0
"""


_LIVE = _live_sql("depth_levels")


def banded_sql(live: str) -> str:
    return f"""
SELECT l.*, m.mid, abs(l.price - m.mid) / m.mid AS distance FROM ({live}) l JOIN (
  SELECT symbol, market, (max(CASE WHEN side = 'BID' THEN price END) + min(CASE WHEN side = 'ASK' THEN price END)) / 2.0e0 AS mid
  FROM ({live}) k GROUP BY 1, 2) m ON l.symbol = m.symbol AND l.market = m.market
WHERE m.mid IS NULL OR (l.price >= m.mid * (1.0e0 - 0.1e0) AND l.price <= m.mid * (1.0e0 + 0.1e0))
"""


BANDED_SQL = banded_sql(_LIVE)


@query(_LIVE)
def reconstruct_book(t: Tables) -> DataFrame:
    return book.reconstruct_book(t.depth_levels)


@query("""
SELECT c.symbol, c.market, c.side, c.price, c.qty, c.last_id FROM (
  SELECT symbol, market, side, price, arg_max(qty, rnk) AS qty, max(update_id) AS last_id FROM (
    SELECT symbol, market, side, price, qty, update_id, update_id * 2 + 1 AS rnk FROM depth_levels
    UNION ALL SELECT d.symbol, d.market, d.side, d.price, d.qty, b.base, b.base * 2 FROM depth_levels d JOIN (
      SELECT symbol, market, max(update_id) // 2 AS base FROM depth_levels GROUP BY 1, 2) b
      ON d.symbol = b.symbol AND d.market = b.market WHERE d.update_id % 3 = 0 AND d.update_id < b.base AND d.qty > 0
      QUALIFY row_number() OVER (PARTITION BY d.symbol, d.market, d.side, d.price ORDER BY d.update_id DESC) = 1) u
  GROUP BY 1, 2, 3, 4) c JOIN (SELECT symbol, market, max(update_id) // 2 AS base FROM depth_levels GROUP BY 1, 2) e
  ON c.symbol = e.symbol AND c.market = e.market WHERE c.qty > 0 AND c.last_id >= e.base
""")
def reconstruct_from_snapshot(t: Tables) -> DataFrame:
    """A snapshot in the middle of each book: every third set level so far, the newest per price."""
    changes = t.depth_levels
    middle = changes.groupBy("symbol", "market").agg(F.expr("max(update_id) div 2").alias("snapshot_id"))
    picked = (changes.filter((F.col("update_id") % 3 == 0) & (F.col("qty") > 0)).join(middle, ["symbol", "market"])
              .filter(F.col("update_id") < F.col("snapshot_id"))
              .groupBy("symbol", "market", "side", "price", "snapshot_id")
              .agg(F.max_by("qty", "update_id").alias("qty")))
    return book.reconstruct_book(changes, snapshot_levels=picked)


@query("""
SELECT symbol, market, side, price, qty, update_id, coalesce(max(CASE WHEN starts THEN recv_ms END) OVER (
    PARTITION BY symbol, market, side, price ORDER BY update_id ROWS UNBOUNDED PRECEDING), -1) AS first_seen_ms
FROM (SELECT *, qty > 0 AND coalesce(lag(qty) OVER (PARTITION BY symbol, market, side, price ORDER BY update_id), 0) = 0 AS starts FROM depth_levels) x
QUALIFY qty > 0
""")
def first_seen(t: Tables) -> DataFrame:
    seen = book.first_seen(t.depth_levels, t.width)
    return seen.filter(F.col("qty") > 0).select("symbol", "market", "side", "price", "qty", "update_id",
                                                "first_seen_ms")


@query(BANDED_SQL)
def with_distance(t: Tables) -> DataFrame:
    return book.with_distance(book.reconstruct_book(t.depth_levels))


VERSIONS_SQL = """
SELECT * FROM (SELECT symbol, market, side, price, qty, update_id, recv_ms AS from_ms,
  lead(recv_ms) OVER (PARTITION BY symbol, market, side, price ORDER BY update_id) AS to_ms FROM depth_levels) v WHERE qty > 0
"""


def last_ms(t: Tables) -> Column:
    return t.depth_levels.select(F.max("recv_ms")).scalar()


def grid_sql(step_ms: int) -> str:
    return f"SELECT unnest(generate_series({START_MS}, (SELECT max(recv_ms) FROM depth_levels), {step_ms})) AS tick_ms"


@query(f"""
SELECT v.symbol, v.market, v.side, v.price, v.qty, v.update_id, g.tick_ms FROM ({VERSIONS_SQL}) v
JOIN ({grid_sql(10_000)}) g ON v.from_ms <= g.tick_ms AND (v.to_ms IS NULL OR g.tick_ms < v.to_ms)
""")
def book_at(t: Tables) -> DataFrame:
    return book.book_at(t.depth_levels, START_MS, last_ms(t), 10_000, t.width)


_MIDS = """
SELECT d.symbol, d.market, d.update_id, max(CASE WHEN v.side = 'BID' THEN v.price END) AS best_bid,
  min(CASE WHEN v.side = 'ASK' THEN v.price END) AS best_ask
FROM (SELECT DISTINCT symbol, market, update_id FROM depth_levels) d
LEFT JOIN (SELECT symbol, market, side, price, qty, update_id AS from_id,
    lead(update_id) OVER (PARTITION BY symbol, market, side, price ORDER BY update_id) AS to_id FROM depth_levels) v
  ON d.symbol = v.symbol AND d.market = v.market AND v.qty > 0 AND v.from_id <= d.update_id AND (v.to_id IS NULL OR d.update_id < v.to_id)
GROUP BY 1, 2, 3
"""


@query(f"""
SELECT symbol, market, update_id, coalesce(best_bid, -1) AS best_bid, coalesce(best_ask, -1) AS best_ask,
  coalesce((best_bid + best_ask) / 2.0e0, -1) AS mid FROM ({_MIDS}) m
""")
def mids(t: Tables) -> DataFrame:
    rows = book.mids(t.depth_levels, t.width)
    return rows.select("symbol", "market", "update_id",
                       *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("best_bid", "best_ask", "mid")])


_SWEPT = f"""
SELECT l.* FROM ({_LIVE}) l JOIN (SELECT symbol, market, update_id,
    max(mid) OVER w AS high, min(mid) OVER w AS low FROM (SELECT symbol, market, update_id, (best_bid + best_ask) / 2.0e0 AS mid FROM ({_MIDS}) m) k
    WINDOW w AS (PARTITION BY symbol, market ORDER BY update_id DESC ROWS UNBOUNDED PRECEDING)) s
  ON l.symbol = s.symbol AND l.market = s.market AND l.last_id = s.update_id
WHERE s.high IS NULL OR (l.price >= s.high * (1.0e0 - 0.1e0) AND l.price <= s.low * (1.0e0 + 0.1e0))
"""


@query(_SWEPT)
def sweep_book(t: Tables) -> DataFrame:
    changes = t.depth_levels
    return book.sweep_book(book.reconstruct_book(changes), book.mids(changes, t.width), width=t.width)


@query(banded_sql(_SWEPT))
def book_of_record(t: Tables) -> DataFrame:
    return book.book_of_record(t.depth_levels, width=t.width)


# The view shows all changes, so its moment is not before the last of them.
_VIEW_MS = f"greatest({AS_OF_MS}, (SELECT max(recv_ms) FROM depth_levels))"


@query(f"""
SELECT b.symbol, b.market, b.side, b.price, b.qty, b.distance, {_VIEW_MS} - f.first_seen_ms AS lifetime_ms,
  count(*) FILTER (WHERE b.side = 'BID') OVER (PARTITION BY b.symbol, b.market) AS bid_count,
  count(*) FILTER (WHERE b.side = 'ASK') OVER (PARTITION BY b.symbol, b.market) AS ask_count, n.state
FROM ({BANDED_SQL}) b JOIN (
  SELECT symbol, market, side, price, update_id, max(CASE WHEN starts THEN recv_ms END) OVER (
      PARTITION BY symbol, market, side, price ORDER BY update_id ROWS UNBOUNDED PRECEDING) AS first_seen_ms
  FROM (SELECT *, qty > 0 AND coalesce(lag(qty) OVER (PARTITION BY symbol, market, side, price ORDER BY update_id), 0) = 0 AS starts
    FROM depth_levels) x) f ON b.symbol = f.symbol AND b.market = f.market AND b.side = f.side AND b.price = f.price AND b.last_id = f.update_id
JOIN ({_now_sql(_STATES, _VIEW_MS)}) n ON b.symbol = n.symbol AND b.market = n.market
""")
def book_view(t: Tables) -> DataFrame:
    """The whole book and its state as of one moment, which is not before the last change."""
    moment = F.greatest(F.lit(AS_OF_MS), last_ms(t))
    levels = book.with_distance(book.reconstruct_book(book.first_seen(t.depth_levels, t.width)))
    view = book.book_view(levels, moment, _states(t))
    return view.select("symbol", "market", "side", "price", "qty", "distance", "lifetime_ms", "bid_count",
                       "ask_count", "state")
