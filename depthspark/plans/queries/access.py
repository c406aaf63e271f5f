"""Grants, access states and gifts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthspark.operators import access
from depthspark.plans.fixtures import Tables
from depthspark.plans.queries import query

AS_OF_S = 1704067200
AS_OF = datetime.fromtimestamp(AS_OF_S, timezone.utc)

# The running form of the fold, over whole users.
_LEDGER = """
SELECT order_id, user_id, source, granted_seconds, at_s, lag(expires_s) OVER w AS previous_s, expires_s FROM (
  SELECT *, s + max(at_s - s + granted_seconds) OVER w AS expires_s FROM (
    SELECT order_id, user_id, source, granted_seconds, CAST(epoch(granted_at) AS BIGINT) AS at_s,
      CAST(sum(granted_seconds) OVER (PARTITION BY user_id ORDER BY granted_at, order_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM grants) a
  WINDOW w AS (PARTITION BY user_id ORDER BY at_s, order_id ROWS UNBOUNDED PRECEDING)) b
WINDOW w AS (PARTITION BY user_id ORDER BY at_s, order_id)
"""


def _ledger(t: Tables) -> DataFrame:
    return access.fold_grants(t.grants.withColumn("grant_id", F.col("order_id")))


@query(f"SELECT order_id, user_id, coalesce(previous_s, -1) AS previous_s, expires_s FROM ({_LEDGER}) x")
def fold_grants(t: Tables) -> DataFrame:
    return _ledger(t).select("order_id", "user_id",
                             F.coalesce(F.unix_seconds("previous_expires_at"), F.lit(-1)).alias("previous_s"),
                             F.unix_seconds("new_expires_at").alias("expires_s"))


@query(f"""
SELECT user_id, arg_max(expires_s, (at_s, order_id)) AS expires_s, bool_or(source = 'PURCHASE') AS has_paid FROM ({_LEDGER}) x GROUP BY 1
""")
def current_entitlement(t: Tables) -> DataFrame:
    return access.current_entitlement(_ledger(t)).select(
        "user_id", F.unix_seconds("access_expires_at").alias("expires_s"), "has_paid")


@query("""
SELECT u.user_id, u.created_s AS granted_s, u.created_s + 604800 AS expires_s FROM users u
""")
def trial_grants(t: Tables) -> DataFrame:
    users = t.users.withColumn("created_at", F.timestamp_seconds("created_s"))
    folded = access.fold_grants(access.trial_grants(users))
    return folded.select("user_id", F.unix_seconds("granted_at").alias("granted_s"),
                         F.unix_seconds("new_expires_at").alias("expires_s"))


_ONCE = "SELECT request_id, user_id, min(days) AS days FROM gift_requests GROUP BY 1, 2"
_VERDICTS = f"""
SELECT o.request_id, count(*) AS users, count(*) FILTER (WHERE u.user_id IS NULL) AS unknown_users,
  CASE WHEN count(*) FILTER (WHERE u.user_id IS NULL) > 0 THEN 'UNKNOWN_USER' ELSE 'OK' END AS verdict
FROM ({_ONCE}) o LEFT JOIN users u ON o.user_id = u.user_id GROUP BY 1
"""


@query(_VERDICTS)
def gift_verdicts(t: Tables) -> DataFrame:
    return access.gift_grants(t.gift_requests, t.users, AS_OF)[1]


@query(f"""
SELECT o.request_id, o.user_id, o.days * 86400 AS granted_seconds FROM ({_ONCE}) o JOIN ({_VERDICTS}) v
  ON o.request_id = v.request_id AND v.verdict = 'OK'
""")
def gift_grants(t: Tables) -> DataFrame:
    return access.gift_grants(t.gift_requests, t.users, AS_OF)[0].select("request_id", "user_id", "granted_seconds")


def _entitlement(t: Tables) -> DataFrame:
    return t.entitlements.withColumn("access_expires_at", F.timestamp_seconds("expires_s"))


@query(f"""
SELECT u.user_id, CASE WHEN u.role = 'ADMIN' THEN 'ADMIN' WHEN e.expires_s IS NULL OR e.expires_s <= {AS_OF_S} THEN 'EXPIRED'
  WHEN e.has_paid THEN 'ACTIVE' ELSE 'TRIAL' END AS state, CASE WHEN u.role = 'ADMIN' THEN -1 ELSE coalesce(e.expires_s, -1) END AS expires_s
FROM users u LEFT JOIN entitlements e ON u.user_id = e.user_id
""")
def access_state(t: Tables) -> DataFrame:
    return access.access_state(t.users, _entitlement(t), AS_OF).select(
        "user_id", "state", F.coalesce(F.unix_seconds("access_expires_at"), F.lit(-1)).alias("expires_s"))


@query(f"""
SELECT u.user_id, u.role = 'ADMIN' OR coalesce(e.expires_s > {AS_OF_S}, false) AS has_access
FROM users u LEFT JOIN entitlements e ON u.user_id = e.user_id
""")
def has_access(t: Tables) -> DataFrame:
    return access.has_access(t.users, _entitlement(t), AS_OF).select("user_id", "has_access")


@query(f"""
SELECT u.user_id, u.role <> 'ADMIN' AND coalesce(e.has_paid AND e.expires_s > {AS_OF_S} + 432000, false) AS blocked
FROM users u LEFT JOIN entitlements e ON u.user_id = e.user_id
""")
def renewal_blocked(t: Tables) -> DataFrame:
    return access.renewal_blocked(t.users, _entitlement(t), AS_OF).select("user_id", "blocked")


@query(f"""
SELECT l.user_id, l.at_s, l.order_id AS grant_id, l.source, l.expires_s, coalesce(o.status, 'none') AS order_status, coalesce(o.plan_code, 'none') AS plan_code
FROM ({_LEDGER}) l LEFT JOIN pay_orders o ON l.source = 'PURCHASE' AND l.order_id = o.order_id
""")
def access_history(t: Tables) -> DataFrame:
    ordered = access.access_history(_ledger(t), t.pay_orders.select("order_id", "status", "plan_code"))
    return ordered.select(
        "user_id", F.unix_seconds(F.col("granted_at").cast("timestamp")).alias("at_s"), "grant_id", "source",
        F.unix_seconds("new_expires_at").alias("expires_s"),
        F.coalesce("order.status", F.lit("none")).alias("order_status"),
        F.coalesce("order.plan_code", F.lit("none")).alias("plan_code"))
