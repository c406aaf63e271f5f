"""Connection log queries. Fixed dates cover all test data."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthspark.operators import usage
from depthspark.plans.fixtures import Tables
from depthspark.plans.queries import query

FIRST, LAST, ZONE = date(2023, 12, 31), date(2024, 12, 31), "Asia/Tashkent"
# Local midnight of the first day and of the day after the last, five hours ahead of UTC.
_FROM, _TO = "TIMESTAMP '2023-12-30 19:00:00'", "TIMESTAMP '2024-12-31 19:00:00'"
_FROM_S = 1703962800
AS_OF_S = 1704067200 + 1_300_000

_WINDOW = f"connected_at >= {_FROM} AND connected_at < {_TO}"
_FIXED = f"""
SELECT {_FROM_S} + b * 1800 AS slice_start, {_FROM_S} + b * 1800 + 1800 AS slice_end, unique_connections FROM (
  SELECT CAST(floor((epoch(connected_at) - {_FROM_S}) / 1800) AS BIGINT) AS b, count(DISTINCT user_id) AS unique_connections
  FROM connection_events WHERE {_WINDOW} GROUP BY 1) x
"""


def _calendar(unit: str) -> str:
    return f"""
SELECT CAST(epoch(s - INTERVAL 5 HOUR) AS BIGINT) AS slice_start, CAST(epoch(s + INTERVAL 1 {unit} - INTERVAL 5 HOUR) AS BIGINT) AS slice_end, n AS unique_connections
FROM (SELECT date_trunc('{unit}', connected_at + INTERVAL 5 HOUR) AS s, count(DISTINCT user_id) AS n
  FROM connection_events WHERE {_WINDOW} GROUP BY 1) x
"""


def _slices(t: Tables, length: str) -> DataFrame:
    return usage.usage_slices(t.connection_events, FIRST, LAST, length, ZONE)


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.unix_seconds(c) for c in df.columns if c.endswith(("_start", "_end"))})


@query(_FIXED)
def usage_fixed(t: Tables) -> DataFrame:
    return _seconds(_slices(t, "PT30M"))


@query(_calendar("month"))
def usage_by_month(t: Tables) -> DataFrame:
    return _seconds(_slices(t, "P1M"))


@query(_calendar("year"))
def usage_by_year(t: Tables) -> DataFrame:
    return _seconds(_slices(t, "P1Y"))


YEARS = usage.UsageWindow.of(date(1992, 1, 1), date(1998, 12, 31), "America/New_York")
_LOCAL = "timezone('America/New_York', timezone('UTC', CAST(connected_at AS TIMESTAMP)))"


def _merged(t: Tables) -> DataFrame:
    """The state of the log over years, from two parts of it that overlap."""
    numbers = usage.user_numbers(t.order_log)
    parts = [t.order_log.filter(f"id % 3 <> {k}") for k in (0, 1)]
    return usage.merge_states(*[usage.usage_state(part, numbers) for part in parts])


@query(f"""
SELECT CAST(epoch(timezone('America/New_York', s)) AS BIGINT) AS slice_start, CAST(epoch(timezone('America/New_York', s + INTERVAL 1 MONTH)) AS BIGINT) AS slice_end, n AS unique_connections
FROM (SELECT date_trunc('month', {_LOCAL}) AS s, count(DISTINCT user_id) AS n FROM order_log WHERE {_LOCAL} >= TIMESTAMP '1992-01-01' AND {_LOCAL} < TIMESTAMP '1999-01-01' GROUP BY 1) x
""")
def usage_months_merged(t: Tables) -> DataFrame:
    """Months over years in a zone with daylight saving, counted from the merged state."""
    return _seconds(usage.state_calendar(_merged(t), YEARS, "month"))


@query(f"""
SELECT a + b * 604800 AS slice_start, a + b * 604800 + 604800 AS slice_end, n AS unique_connections FROM (
  SELECT {YEARS.start_epoch} AS a, CAST(floor((epoch(CAST(connected_at AS TIMESTAMP)) - {YEARS.start_epoch}) / 604800) AS BIGINT) AS b, count(DISTINCT user_id) AS n
  FROM order_log WHERE epoch(CAST(connected_at AS TIMESTAMP)) >= {YEARS.start_epoch} AND epoch(CAST(connected_at AS TIMESTAMP)) < {int(YEARS.end.timestamp())} GROUP BY 2) x
""")
def usage_weeks_merged(t: Tables) -> DataFrame:
    return _seconds(usage.state_fixed(_merged(t), YEARS, 604_800))


@query(f"""
SELECT count(*) AS slice_count, CAST(sum(unique_connections) AS BIGINT) AS total_connections,
  (SELECT slice_start FROM ({_FIXED}) y ORDER BY unique_connections DESC, slice_start LIMIT 1) AS most_active_start,
  max(unique_connections) AS most_active FROM ({_FIXED}) z
""")
def usage_report(t: Tables) -> DataFrame:
    return _seconds(usage.usage_report(_slices(t, "PT30M")))


_PRESENT = f"""
SELECT s.user_id, count(*) AS sessions, s.user_id IN (SELECT user_id FROM user_rules) AS custom FROM sessions s
WHERE s.opened_s <= {AS_OF_S} AND (s.closed_s IS NULL OR s.closed_s > {AS_OF_S}) GROUP BY 1
"""


@query(_PRESENT)
def presence(t: Tables) -> DataFrame:
    return usage.presence(t.sessions, AS_OF_S, t.user_rules)


@query(f"SELECT count(*) AS online_users, CAST(coalesce(sum(sessions), 0) AS BIGINT) AS total_sessions FROM ({_PRESENT}) p")
def presence_totals(t: Tables) -> DataFrame:
    return usage.presence_totals(usage.presence(t.sessions, AS_OF_S, t.user_rules))


@query("SELECT user_id, CAST(epoch_us(max(connected_at)) AS BIGINT) AS last_seen_us FROM connection_events GROUP BY 1")
def last_seen(t: Tables) -> DataFrame:
    seen = usage.last_seen(t.connection_events)
    return seen.select("user_id", F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("last_seen_us"))
