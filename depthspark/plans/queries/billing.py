"""Plans, money, orders and payments."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthspark.functions import currency as cur
from depthspark.operators import access, money, orders
from depthspark.plans import payments
from depthspark.plans.fixtures import Tables
from depthspark.plans.queries import query
from depthspark.plans.queries.access import AS_OF, AS_OF_S as MIDNIGHT_S

AS_OF_S = MIDNIGHT_S + 1800
ALLOWED_IP = "10.0.0.1"


def _money(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", cur.major_units(F.col("amount_minor"))).drop("amount_minor")


def _requests(t: Tables) -> DataFrame:
    return t.quote_requests.withColumn("amount", F.col("amount_text").try_cast(cur.MONEY))


def _orders(t: Tables) -> DataFrame:
    return _money(t.pay_orders).withColumn("currency", F.lit("UZS"))


# --- plans and money ---------------------------------------------------------------------------


@query("""
SELECT p.code, p.type, coalesce(p.duration_days, -1) AS duration_days, q.amount_minor,
  concat(CAST(q.amount_minor // 100 AS STRING), '.', lpad(CAST(q.amount_minor % 100 AS STRING), 2, '0')) AS amount_text
FROM catalog_plans p JOIN catalog_prices q ON p.code = q.code AND q.active AND q.currency = 'UZS' WHERE p.active
""")
def plan_catalog(t: Tables) -> DataFrame:
    listed = money.plan_catalog(t.catalog_plans, _money(t.catalog_prices), " uzs")
    return listed.select("code", "type", F.coalesce("duration_days", F.lit(-1)).alias("duration_days"),
                         cur.minor_units(F.col("amount")).alias("amount_minor"), "amount_text")


@query("""
SELECT p.code, p.active, coalesce(string_agg(concat(q.currency, CAST(q.amount_minor AS STRING), CAST(q.active AS STRING)), ',' ORDER BY q.currency), '') AS prices
FROM catalog_plans p LEFT JOIN catalog_prices q ON p.code = q.code GROUP BY 1, 2
""")
def plan_admin_view(t: Tables) -> DataFrame:
    view = money.plan_admin_view(t.catalog_plans, _money(t.catalog_prices))
    text = F.transform("prices", lambda x: F.concat(
        x["currency"], cur.minor_units(x["amount"]).cast("string"), x["active"].cast("string")))
    return view.select("code", "active", F.array_join(text, ",").alias("prices"))


_NAMED = """
SELECT request_id, upper(trim(currency)) AS code, CAST(amount_text AS DECIMAL(38, 18)) AS amount,
  CASE upper(trim(currency)) WHEN 'UZS' THEN 2 WHEN 'USD' THEN 2 WHEN 'BTC' THEN 8 WHEN 'ETH' THEN 18 END AS digits FROM quote_requests
"""
_CHECKED = f"""
SELECT *, CASE WHEN length(code) <> 3 THEN 'BAD_CODE' WHEN digits IS NULL THEN 'UNSUPPORTED_CURRENCY'
  WHEN (digits = 2 AND amount <> round(amount, 2)) OR (digits = 8 AND amount <> round(amount, 8)) THEN 'TOO_MANY_DECIMALS' END AS error FROM ({_NAMED}) n
"""


@query(f"SELECT request_id, code, coalesce(error, 'OK') AS error FROM ({_CHECKED}) c")
def check_money(t: Tables) -> DataFrame:
    return money.check_money(_requests(t)).select("request_id", "code", F.coalesce("error", F.lit("OK")).alias("error"))


@query(f"""
SELECT request_id, coalesce(CASE WHEN error IS NULL AND digits = 2 THEN CAST(CAST(amount AS DECIMAL(38, 2)) AS STRING)
  WHEN error IS NULL AND digits = 8 THEN CAST(CAST(amount AS DECIMAL(38, 8)) AS STRING)
  WHEN error IS NULL THEN CAST(amount AS STRING) END, 'none') AS amount_text FROM ({_CHECKED}) c
""")
def display_amount(t: Tables) -> DataFrame:
    return money.display_amount(_requests(t).drop("amount_text")).select(
        "request_id", F.coalesce("amount_text", F.lit("none")).alias("amount_text"))


@query(f"""
SELECT request_id, CASE WHEN amount = round(amount, 2) THEN CAST(amount * 100 AS BIGINT) ELSE -999999 END AS minor FROM ({_NAMED}) n
""")
def to_minor(t: Tables) -> DataFrame:
    return money.to_minor(_requests(t)).select("request_id", F.coalesce("minor", F.lit(-999999)).alias("minor"))


# Whole numbers of the smallest unit, 10^-18, so that the ceiling is exact here too.
@query(f"""
SELECT request_id, CASE WHEN failed = 'OK' THEN CAST((CAST(replace(CAST(amount AS STRING), '.', '') AS HUGEINT) + 8000000000000000000000 - 1)
    // 8000000000000000000000 AS BIGINT) ELSE -1 END AS days, failed AS error FROM (
  SELECT *, CASE WHEN error IN ('BAD_CODE', 'UNSUPPORTED_CURRENCY') THEN error WHEN code <> 'UZS' THEN 'NO_PRICE'
    WHEN amount <= 0 THEN 'AMOUNT_NOT_POSITIVE' WHEN error IS NOT NULL THEN error ELSE 'OK' END AS failed FROM ({_CHECKED}) c) d
""")
def quote_days(t: Tables) -> DataFrame:
    quoted = money.quote_days(_requests(t), t.plans, _money(t.plan_prices))
    return quoted.select("request_id", F.coalesce("days", F.lit(-1)).alias("days"),
                         F.coalesce("error", F.lit("OK")).alias("error"))


# --- orders ------------------------------------------------------------------------------------


@query("""
SELECT o.order_id, o.user_id, o.status, o.plan_code, p.type AS plan_type, coalesce(h.reason, 'none') AS reason FROM pay_orders o
JOIN plans p ON o.plan_code = p.code
LEFT JOIN (SELECT order_id, reason FROM status_history QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) = 1) h ON o.order_id = h.order_id
""")
def order_details(t: Tables) -> DataFrame:
    details = orders.order_details(_orders(t), t.plans, t.status_history)
    return details.select("order_id", "user_id", "status", "plan_code", "plan_type",
                          F.coalesce("reason", F.lit("none")).alias("reason"))


@query("""
SELECT user_id, order_id, created_s, n AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_s DESC, order_id DESC) AS n FROM pay_orders) x WHERE n <= 100
""")
def order_list(t: Tables) -> DataFrame:
    return orders.order_list(_orders(t)).select("user_id", "order_id", "created_s", F.col("place").cast("bigint").alias("place"))


_CURRENT = """
SELECT * FROM pay_orders QUALIFY row_number() OVER (PARTITION BY user_id
  ORDER BY status IN ('CREATED', 'PENDING') DESC, created_s DESC, order_id DESC) = 1
"""


@query(f"SELECT user_id, order_id, status, plan_code FROM ({_CURRENT}) c")
def current_order(t: Tables) -> DataFrame:
    return orders.current_order(_orders(t)).select("user_id", "order_id", "status", "plan_code")


@query("SELECT order_id, seq, to_status, coalesce(reason, 'none') AS reason FROM status_history WHERE order_id = 77")
def order_history(t: Tables) -> DataFrame:
    return orders.order_history(t.status_history, 77).select(
        "order_id", F.col("seq").cast("bigint").alias("seq"), "to_status", F.coalesce("reason", F.lit("none")).alias("reason"))


@query("""
SELECT order_id, seq, CASE WHEN from_status = to_status THEN 'REPEAT' WHEN from_status IS NULL THEN 'LEGAL'
  WHEN concat(from_status, '>', to_status) IN ('CREATED>PENDING', 'CREATED>CANCELED', 'CREATED>EXPIRED', 'PENDING>PAID', 'PENDING>EXPIRED',
    'PENDING>FAILED', 'PENDING>CANCELED', 'PENDING>REVERTED', 'PAID>REVERTED', 'EXPIRED>PAID', 'FAILED>PAID', 'CANCELED>PAID') THEN 'LEGAL'
  ELSE 'ILLEGAL' END AS verdict,
  from_status IS NOT DISTINCT FROM lag(to_status) OVER (PARTITION BY order_id ORDER BY seq) AS chained
FROM status_steps
""")
def transition_audit(t: Tables) -> DataFrame:
    audited = orders.transition_audit(t.status_steps.withColumn("seq", F.col("seq").cast("bigint")))
    return audited.select("order_id", "seq", "verdict", "chained")


_MAPPED = """
SELECT *, CASE WHEN error_code = 'ERROR_NOT_FOUND' THEN 'NOT_FOUND' WHEN error_code IS NOT NULL THEN NULL
  WHEN raw_status = 'success' THEN 'SUCCESS' WHEN raw_status = 'error' THEN 'ERROR' WHEN raw_status = 'revert' THEN 'REVERT'
  WHEN raw_status IN ('cancelled', 'canceled') THEN 'CANCELED' ELSE 'PENDING' END AS answer FROM provider_payments
"""


@query(f"SELECT provider_uuid, coalesce(answer, 'none') AS status FROM ({_MAPPED}) m")
def map_provider_status(t: Tables) -> DataFrame:
    return orders.map_provider_status(t.provider_payments).select(
        "provider_uuid", F.coalesce("status", F.lit("none")).alias("status"))


@query(f"""
SELECT order_id, CASE WHEN uuid IS NULL THEN CASE WHEN stale THEN 'EXPIRE' ELSE 'NONE' END
    WHEN answer = 'SUCCESS' THEN CASE WHEN total_minor = amount_minor THEN 'GRANT' ELSE 'FAIL' END
    WHEN answer = 'ERROR' THEN 'FAIL' WHEN answer = 'REVERT' THEN 'REVERT' WHEN answer IN ('CANCELED', 'NOT_FOUND') THEN 'EXPIRE'
    WHEN answer = 'PENDING' AND stale THEN 'EXPIRE' ELSE 'NONE' END AS action,
  coalesce(CASE WHEN uuid IS NULL THEN CASE WHEN stale THEN 'INVOICE_EXPIRED' END
    WHEN answer = 'SUCCESS' THEN CASE WHEN total_minor = amount_minor THEN 'RECONCILED_GRANT' ELSE 'AMOUNT_MISMATCH' END
    WHEN answer = 'ERROR' THEN 'PROVIDER_ERROR' WHEN answer = 'REVERT' THEN 'PROVIDER_REVERT'
    WHEN answer IN ('CANCELED', 'NOT_FOUND') OR (answer = 'PENDING' AND stale) THEN 'INVOICE_EXPIRED' END, 'none') AS reason,
  CASE WHEN answer = 'SUCCESS' AND total_minor <> amount_minor THEN
    concat('reconciliation: provider=', CAST(total_minor AS STRING), ' expected=', CAST(amount_minor AS STRING)) ELSE 'none' END AS detail
FROM (SELECT o.*, o.provider_uuid AS uuid, o.expires_s <= {AS_OF_S} AS stale, m.answer, m.total_minor FROM pay_orders o
  LEFT JOIN ({_MAPPED}) m ON o.provider_uuid = m.provider_uuid WHERE o.status = 'PENDING') x
""")
def reconcile(t: Tables) -> DataFrame:
    decided = orders.reconcile(_orders(t), t.provider_payments, AS_OF_S)
    return decided.select("order_id", "action", F.coalesce("reason", F.lit("none")).alias("reason"),
                          F.coalesce("detail", F.lit("none")).alias("detail"))


@query(f"""
SELECT callback_id, CASE WHEN source_ip <> '{ALLOWED_IP}' THEN 'BAD_SOURCE'
    WHEN sign <> md5(concat(store_id, invoice_id, CAST(amount AS STRING), 'fixture-key')) THEN 'BAD_SIGN'
    WHEN order_id IS NULL THEN 'REJECT' WHEN status = 'PAID' THEN 'OK' WHEN amount <> amount_minor THEN 'REJECT'
    WHEN status = 'CREATED' THEN 'RETRY' ELSE 'OK' END AS outcome,
  CASE WHEN source_ip <> '{ALLOWED_IP}' OR sign <> md5(concat(store_id, invoice_id, CAST(amount AS STRING), 'fixture-key')) THEN 'none'
    WHEN order_id IS NULL THEN 'UNKNOWN_ORDER' WHEN status <> 'PAID' AND amount <> amount_minor THEN 'AMOUNT_MISMATCH' ELSE 'none' END AS reason
FROM (SELECT c.*, o.order_id, o.status, o.amount_minor FROM callbacks c LEFT JOIN pay_orders o ON c.uuid = o.provider_uuid) x
""")
def callback_audit(t: Tables) -> DataFrame:
    secrets = t.spark.createDataFrame([("fixture-key",)], "secret string")
    audited = orders.callback_audit(t.callbacks, _orders(t), secrets, ALLOWED_IP)
    return audited.select("callback_id", "outcome", F.coalesce("reason", F.lit("none")).alias("reason"))


_JUDGED = """
SELECT s.*, CASE WHEN o.status = 'PAID' THEN 'SKIP_PAID' WHEN o.status = 'REVERTED' THEN 'REFUSE_REVERTED' WHEN o.status = 'PENDING' THEN 'GRANT'
  WHEN s.source <> 'CALLBACK' THEN 'NO_RESCUE' WHEN o.status = 'CREATED' THEN 'ILLEGAL' ELSE 'GRANT' END AS judged
FROM success_signals s JOIN pay_orders o ON s.order_id = o.order_id
"""


# Place of each signal in its order's history, and the place of the one that grants.
_PLACED = f"""
SELECT *, min(CASE WHEN judged = 'GRANT' THEN place END) OVER (PARTITION BY order_id) AS granted
FROM (SELECT j.*, row_number() OVER (PARTITION BY order_id ORDER BY at_s, signal_id) AS place FROM ({_JUDGED}) j) k
"""


@query(f"""
SELECT signal_id, order_id, CASE WHEN place > granted THEN 'ALREADY_GRANTED' ELSE judged END AS verdict FROM ({_PLACED}) p
""")
def grants_from_success(t: Tables) -> DataFrame:
    return orders.grants_from_success(t.success_signals, _orders(t))[1].select("signal_id", "order_id", "verdict")


@query(f"""
SELECT 'order-' || CAST(p.order_id AS VARCHAR) AS grant_id, p.order_id, o.user_id, CAST(p.at_s AS BIGINT) AS at_s, 'PURCHASE' AS source, true AS paid
FROM ({_PLACED}) p JOIN pay_orders o ON p.order_id = o.order_id WHERE p.place = p.granted
""")
def purchase_grants(t: Tables) -> DataFrame:
    grants = orders.grants_from_success(t.success_signals, _orders(t))[0]
    return grants.select("grant_id", "order_id", "user_id", F.unix_seconds("granted_at").alias("at_s"), "source", "paid")


def _known(t: Tables) -> DataFrame:
    return _orders(t).withColumn("granted_seconds", (F.lit(86_400) * (1 + F.col("order_id") % 45)).cast("bigint"))


@query(f"""
SELECT p.order_id, o.status AS from_status, 'PAID' AS to_status, CAST(p.at_s AS BIGINT) AS at_s, p.source
FROM ({_PLACED}) p JOIN pay_orders o ON p.order_id = o.order_id WHERE p.place = p.granted
""")
def applied_history(t: Tables) -> DataFrame:
    return payments.applied_history(t.success_signals, _known(t))


AFTER_S = AS_OF_S + 30 * 86_400


@query(f"""
SELECT u.user_id, CASE WHEN u.role = 'ADMIN' THEN 'ADMIN' WHEN e.expires_s IS NULL OR e.expires_s <= {AFTER_S} THEN 'EXPIRED'
  WHEN e.has_paid THEN 'ACTIVE' ELSE 'TRIAL' END AS state, CASE WHEN u.role = 'ADMIN' THEN -1 ELSE coalesce(e.expires_s, -1) END AS expires_s
FROM users u LEFT JOIN (
  SELECT user_id, CAST(sum(g) + max(at_s - s + g) AS BIGINT) AS expires_s, bool_or(source = 'PURCHASE') AS has_paid FROM (
    SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY at_s, id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT concat('old-', CAST(order_id AS STRING)) AS id, user_id, CAST(epoch(granted_at) AS BIGINT) AS at_s, granted_seconds AS g, source FROM grants
      UNION ALL SELECT concat('order-', CAST(p.order_id AS STRING)), o.user_id, CAST(p.at_s AS BIGINT), CAST(86400 * (1 + p.order_id % 45) AS BIGINT), 'PURCHASE'
      FROM ({_PLACED}) p JOIN pay_orders o ON p.order_id = o.order_id WHERE p.place = p.granted) a) b GROUP BY 1) e ON u.user_id = e.user_id
""")
def access_after_payments(t: Tables) -> DataFrame:
    ledger = t.grants.withColumn("grant_id", F.concat(F.lit("old-"), F.col("order_id").cast("string")))
    state = payments.access_after(t.success_signals, _known(t), ledger, t.users, datetime.fromtimestamp(AFTER_S, timezone.utc))
    return state.select("user_id", "state", F.coalesce(F.unix_seconds("access_expires_at"), F.lit(-1)).alias("expires_s"))


# Each order's log is walked event by event; the state after an event is what the next one meets.
_LOG = f"""
WITH RECURSIVE answers AS (SELECT *, CASE WHEN error_code = 'ERROR_NOT_FOUND' THEN 'NOT_FOUND' WHEN error_code IS NOT NULL THEN NULL WHEN raw_status = 'success' THEN 'SUCCESS'
    WHEN raw_status = 'error' THEN 'ERROR' WHEN raw_status = 'revert' THEN 'REVERT' WHEN raw_status IN ('cancelled', 'canceled') THEN 'CANCELED' ELSE 'PENDING' END AS answer FROM sweep_log),
event AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY at_s, source, event_id) AS n FROM (
  SELECT o.order_id, c.at_s, 'CALLBACK' AS source, CAST(c.callback_id AS STRING) AS event_id, o.status AS first, CASE WHEN c.source_ip <> '{ALLOWED_IP}' THEN 'BAD_SOURCE'
      WHEN c.sign <> md5(concat(c.store_id, c.invoice_id, CAST(c.amount AS STRING), 'fixture-key')) THEN 'BAD_SIGN' WHEN c.amount <> o.amount_minor THEN 'MISMATCH' ELSE 'PAY' END AS does, NULL AS why
  FROM callback_log c JOIN pay_orders o ON c.uuid = o.provider_uuid
  UNION ALL SELECT o.order_id, a.at_s, 'RECONCILIATION', a.sweep_id, o.status,
    CASE WHEN answer = 'SUCCESS' THEN CASE WHEN a.total_minor = o.amount_minor THEN 'GRANT' ELSE 'FAIL' END WHEN answer = 'ERROR' THEN 'FAIL' WHEN answer = 'REVERT' THEN 'REVERT'
      WHEN answer IN ('CANCELED', 'NOT_FOUND') OR (answer = 'PENDING' AND o.expires_s <= a.at_s) THEN 'EXPIRE' ELSE 'NONE' END,
    CASE WHEN answer = 'SUCCESS' THEN CASE WHEN a.total_minor = o.amount_minor THEN 'RECONCILED_GRANT' ELSE 'AMOUNT_MISMATCH' END WHEN answer = 'ERROR' THEN 'PROVIDER_ERROR'
      WHEN answer = 'REVERT' THEN 'PROVIDER_REVERT' WHEN answer IN ('CANCELED', 'NOT_FOUND') OR (answer = 'PENDING' AND o.expires_s <= a.at_s) THEN 'INVOICE_EXPIRED' END
  FROM answers a JOIN pay_orders o ON a.provider_uuid = o.provider_uuid) x),
walk AS (SELECT order_id, 0 AS n, first AS before, first AS after FROM event WHERE n = 1
  UNION ALL SELECT e.order_id, e.n, w.after, CASE WHEN e.source = 'CALLBACK' THEN CASE WHEN e.does = 'PAY' AND w.after IN ('PENDING', 'EXPIRED', 'FAILED', 'CANCELED') THEN 'PAID' ELSE w.after END
    WHEN w.after <> 'PENDING' THEN w.after WHEN e.does = 'GRANT' THEN 'PAID' WHEN e.does = 'FAIL' THEN 'FAILED' WHEN e.does = 'REVERT' THEN 'REVERTED' WHEN e.does = 'EXPIRE' THEN 'EXPIRED' ELSE w.after END
  FROM walk w JOIN event e ON e.order_id = w.order_id AND e.n = w.n + 1),
told AS (SELECT e.*, w.before, w.after, w.before <> 'PAID' AND w.after = 'PAID' AS grants FROM walk w JOIN event e ON e.order_id = w.order_id AND e.n = w.n)
"""


def _log(t: Tables) -> DataFrame:
    secrets = t.spark.createDataFrame([("fixture-key",)], "secret string")
    return orders.payment_log(t.callback_log, t.sweep_log, _orders(t), secrets, ALLOWED_IP)


@query(_LOG + """
SELECT order_id, at_s, source, event_id, before, CASE WHEN does IN ('BAD_SOURCE', 'BAD_SIGN') THEN does WHEN source = 'CALLBACK' THEN
    CASE WHEN grants THEN 'GRANT' WHEN before = 'PAID' THEN 'OK' WHEN does = 'MISMATCH' THEN 'REJECT' WHEN before = 'CREATED' THEN 'RETRY' ELSE 'OK' END
  WHEN before = 'PENDING' THEN does ELSE 'NONE' END AS action,
  coalesce(CASE WHEN source = 'CALLBACK' THEN CASE WHEN grants THEN 'CALLBACK_GRANT' WHEN does = 'MISMATCH' AND before <> 'PAID' THEN 'AMOUNT_MISMATCH' END WHEN before = 'PENDING' THEN why END, 'none') AS reason,
  after, grants FROM told
""")
def payment_log(t: Tables) -> DataFrame:
    return _log(t).withColumn("reason", F.coalesce("reason", F.lit("none")))


@query(_LOG + f"""
SELECT u.user_id, CASE WHEN u.role = 'ADMIN' THEN 'ADMIN' WHEN e.expires_s IS NULL OR e.expires_s <= {AFTER_S} THEN 'EXPIRED'
  WHEN e.has_paid THEN 'ACTIVE' ELSE 'TRIAL' END AS state, CASE WHEN u.role = 'ADMIN' THEN -1 ELSE coalesce(e.expires_s, -1) END AS expires_s
FROM users u LEFT JOIN (
  SELECT user_id, CAST(sum(g) + max(at_s - s + g) AS BIGINT) AS expires_s, bool_or(source = 'PURCHASE') AS has_paid FROM (
    SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY at_s, id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT concat('old-', CAST(order_id AS STRING)) AS id, user_id, CAST(epoch(granted_at) AS BIGINT) AS at_s, granted_seconds AS g, source FROM grants
      UNION ALL SELECT concat('order-', CAST(p.order_id AS STRING)), o.user_id, CAST(p.at_s AS BIGINT), CAST(86400 * (1 + p.order_id % 45) AS BIGINT), 'PURCHASE'
      FROM told p JOIN pay_orders o ON p.order_id = o.order_id WHERE p.grants) a) b GROUP BY 1) e ON u.user_id = e.user_id
""")
def access_from_logs(t: Tables) -> DataFrame:
    """Logs of callbacks and of provider answers to the access of every user, as one plan."""
    secrets = t.spark.createDataFrame([("fixture-key",)], "secret string")
    ledger = t.grants.withColumn("grant_id", F.concat(F.lit("old-"), F.col("order_id").cast("string")))
    state = payments.access_from_logs(t.callback_log, t.sweep_log, _known(t), secrets, ALLOWED_IP, ledger, t.users, datetime.fromtimestamp(AFTER_S, timezone.utc))
    return state.select("user_id", "state", F.coalesce(F.unix_seconds("access_expires_at"), F.lit(-1)).alias("expires_s"))


_PRICED = "SELECT code, currency, amount_minor FROM plan_prices WHERE active"
_DECIDED = f"""
SELECT r.request_id, r.user_id, r.plan_code, r.currency, r.amount_minor, r.request_id = min(r.request_id) OVER (PARTITION BY r.user_id) AS turn, r.kind,
  c.order_id AS current_order_id, coalesce(c.status IN ('CREATED', 'PENDING'), false) AS open_now, c.expires_s <= {AS_OF_S} AS stale, c.plan_code AS current_plan,
  CASE WHEN r.kind = 'CREATE' AND p.code IS NULL THEN 'UNKNOWN_PLAN'
    WHEN r.kind = 'CREATE' AND p.type = 'FIXED' AND u.role <> 'ADMIN' AND coalesce(e.has_paid AND e.expires_s > {MIDNIGHT_S} + 432000, false) THEN 'ALREADY_SUBSCRIBED'
    WHEN r.kind = 'CREATE' AND q.code IS NULL THEN 'NO_PRICE' WHEN r.kind = 'CANCEL' AND c.order_id IS NULL THEN 'NO_ORDERS'
    WHEN r.kind = 'CANCEL' AND c.status <> 'PENDING' THEN 'NOT_PENDING'
    WHEN r.kind = 'CREATE' AND p.type <> 'FIXED' AND r.amount_minor <= 0
      AND NOT coalesce(c.status IN ('CREATED', 'PENDING') AND c.expires_s > {AS_OF_S} AND c.plan_code = r.plan_code, false) THEN 'AMOUNT_NOT_POSITIVE' END AS failed
FROM order_requests r LEFT JOIN (SELECT * FROM plans WHERE active) p ON r.plan_code = p.code
LEFT JOIN ({_PRICED}) q ON r.plan_code = q.code AND r.currency = q.currency LEFT JOIN ({_CURRENT}) c ON r.user_id = c.user_id
LEFT JOIN users u ON r.user_id = u.user_id LEFT JOIN entitlements e ON r.user_id = e.user_id
"""


@query(f"""
SELECT request_id, CASE WHEN NOT turn THEN 'WAIT' WHEN failed IS NOT NULL THEN 'REJECT' WHEN kind = 'CANCEL' THEN 'CANCEL' WHEN NOT open_now THEN 'CREATE'
  WHEN stale THEN 'EXPIRE_AND_CREATE' WHEN plan_code = current_plan THEN 'REUSE' ELSE 'SUPERSEDE_AND_CREATE' END AS decision,
  CASE WHEN turn THEN coalesce(failed, 'none') ELSE 'none' END AS error FROM ({_DECIDED}) d
""")
def order_decision(t: Tables) -> DataFrame:
    return _decided(t).select("request_id", "decision", F.coalesce("error", F.lit("none")).alias("error"))


def _decided(t: Tables) -> DataFrame:
    entitlement = t.entitlements.withColumn("access_expires_at", F.timestamp_seconds("expires_s"))
    blocked = access.renewal_blocked(t.users, entitlement, AS_OF)
    return orders.order_decision(_money(t.order_requests), _orders(t), t.plans, _money(t.plan_prices), blocked, AS_OF_S)


@query(f"""
SELECT d.request_id, d.plan_code, CASE WHEN p.type = 'FIXED' THEN CAST(p.duration_days AS BIGINT) ELSE (d.amount_minor + q.amount_minor - 1) // q.amount_minor END AS days,
  86400 * CASE WHEN p.type = 'FIXED' THEN CAST(p.duration_days AS BIGINT) ELSE (d.amount_minor + q.amount_minor - 1) // q.amount_minor END AS granted_seconds,
  CASE WHEN p.type = 'FIXED' THEN q.amount_minor ELSE d.amount_minor END AS amount_minor, CAST({AS_OF_S} + 1800 AS BIGINT) AS expires_s
FROM ({_DECIDED}) d JOIN plans p ON d.plan_code = p.code JOIN ({_PRICED}) q ON d.plan_code = q.code AND d.currency = q.currency
WHERE d.turn AND d.failed IS NULL AND d.kind = 'CREATE' AND NOT (d.open_now AND NOT d.stale AND d.plan_code = d.current_plan)
""")
def order_terms(t: Tables) -> DataFrame:
    accepted = _decided(t).filter(F.col("decision").endswith("CREATE"))
    terms = orders.order_terms(accepted, t.plans, _money(t.plan_prices), AS_OF_S)
    return terms.select("request_id", "plan_code", "days", "granted_seconds",
                        cur.minor_units(F.col("amount")).alias("amount_minor"),
                        F.col("expires_s").cast("bigint").alias("expires_s"))


def _many(name: str, table: str, keys: str, where: str = "true") -> str:
    return f"SELECT '{name}' AS \"constraint\", (SELECT count(*) FROM (SELECT {keys} FROM {table} WHERE {where} GROUP BY {keys} HAVING count(*) > 1) x) AS violations"


def _rows(name: str, table: str, where: str) -> str:
    return f"SELECT '{name}', (SELECT count(*) FROM {table} c WHERE {where})"


def _lost(name: str, table: str, column: str, parent: str, key: str) -> str:
    return _rows(name, table, f"c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})")


@query(" UNION ALL ".join([
    _many("users_unique", "accounts", "user_id"), _rows("users_role", "accounts", "role NOT IN ('USER', 'ADMIN')"),
    _many("users_unique_email", "accounts", "email", "email IS NOT NULL"), _rows("users_not_null", "accounts", "user_id IS NULL OR role IS NULL OR email IS NULL"),
    _many("rules_unique_tier", "user_rules", "user_id, symbol, market, tier_no"),
    _lost("rules_user", "user_rules", "user_id", "users", "user_id"),
    _rows("rules_not_null", "user_rules", "user_id IS NULL OR symbol IS NULL OR market IS NULL OR tier_no IS NULL OR min_notional IS NULL OR max_distance IS NULL"),
    _many("plans_unique_code", "plans", "code"), _rows("plans_type", "plans", "type NOT IN ('FIXED', 'PER_DAY')"),
    _rows("plans_duration", "plans", "(type = 'FIXED') <> (duration_days IS NOT NULL)"),
    _many("prices_unique", "plan_prices", "code, currency"), _rows("prices_amount", "plan_prices", "amount_minor < 0"),
    _lost("prices_plan", "plan_prices", "code", "plans", "code"),
    _many("orders_unique", "pay_orders", "order_id"),
    _rows("orders_status", "pay_orders", "status NOT IN ('CREATED', 'PENDING', 'PAID', 'EXPIRED', 'FAILED', 'CANCELED', 'REVERTED')"),
    _rows("orders_amount", "pay_orders", "amount_minor < 0"),
    _rows("orders_not_null", "pay_orders", "order_id IS NULL OR user_id IS NULL OR status IS NULL OR amount_minor IS NULL"),
    _many("orders_one_open", "pay_orders", "user_id", "status IN ('CREATED', 'PENDING')"),
    _many("orders_provider_uuid", "pay_orders", "provider_uuid", "provider_uuid IS NOT NULL"),
    _lost("orders_user", "pay_orders", "user_id", "users", "user_id"),
    _lost("orders_plan", "pay_orders", "plan_code", "plans", "code"),
    _lost("history_order", "status_history", "order_id", "pay_orders", "order_id"),
    _lost("ledger_user", "ledger", "user_id", "users", "user_id"),
    _lost("ledger_order", "ledger", "order_id", "pay_orders", "order_id"),
    _lost("ledger_admin", "ledger", "admin_id", "users", "user_id"),
    _rows("ledger_not_null", "ledger", "user_id IS NULL OR source IS NULL OR granted_seconds IS NULL"),
    _lost("connections_user", "connection_events", "user_id", "users", "user_id"),
    _many("entitlement_unique", "entitlements", "user_id"), _lost("entitlement_user", "entitlements", "user_id", "users", "user_id"),
    _rows("entitlement_not_null", "entitlements", "user_id IS NULL OR has_paid IS NULL"),
]))
def constraint_audit(t: Tables) -> DataFrame:
    return orders.constraint_audit(t.accounts, t.user_rules, t.plans, _money(t.plan_prices), _orders(t), t.status_history,
                                   t.ledger, t.connection_events, t.entitlements)


@query(f"""
SELECT * FROM (SELECT u.user_id, u.created_s, CASE WHEN u.role = 'ADMIN' THEN 'ADMIN' WHEN e.expires_s IS NULL OR e.expires_s <= {AS_OF_S} THEN 'EXPIRED'
    WHEN e.has_paid THEN 'ACTIVE' ELSE 'TRIAL' END AS state, coalesce(e.expires_s, -1) AS expires_s, coalesce(e.has_paid, false) AS has_paid
  FROM users u LEFT JOIN entitlements e ON u.user_id = e.user_id ORDER BY u.created_s DESC, u.user_id LIMIT 100 OFFSET 100) x
""")
def user_directory(t: Tables) -> DataFrame:
    page = orders.user_directory(t.users, t.entitlements, AS_OF_S, page=1, size=500)
    return page.select("user_id", "created_s", "state", F.coalesce("expires_s", F.lit(-1)).alias("expires_s"), "has_paid")


@query("SELECT count(*) AS total_users, (count(*) + 19) // 20 AS total_pages FROM users")
def directory_totals(t: Tables) -> DataFrame:
    return orders.directory_totals(t.users, 0)
