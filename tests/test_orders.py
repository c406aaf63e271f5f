from __future__ import annotations

import hashlib
from decimal import Decimal as D

from pyspark.sql import functions as F

from depthspark.functions import payments as pay
from depthspark.operators import orders
from tests.conftest import rows
from tests.test_money import plans, prices

ORDERS = ("order_id int, user_id string, status string, plan_code string, amount decimal(38,18), currency string, provider_uuid string, "
          "expires_s bigint, created_s bigint")
NOW = 1000


def order(i, status="PENDING", user="u", plan="weekly", amount=D(1), uuid=True, expires=2000, created=0):
    return (i, user, status, plan, amount, "UZS", f"p{i}" if uuid else None, expires, created)


def test_moves(spark):
    assert sum(map(len, pay.MOVES.values())) == 12
    steps = [("o", 1, None, "CREATED"), ("o", 5, "CREATED", "PENDING"), ("o", 9, "PENDING", "EXPIRED"), ("o", 12, "EXPIRED", "PAID"),
             ("o", 13, "PAID", "PAID"), ("o", 14, "PAID", "REVERTED"), ("o", 20, "REVERTED", "PAID"), ("x", 2, "CREATED", "PAID"),
             ("x", 3, "PENDING", "PAID")]
    df = spark.createDataFrame(steps, "order_id string, seq bigint, from_status string, to_status string")
    got = rows(orders.transition_audit(df), "order_id", "seq", "verdict", "chained")
    assert got == [("o", 1, "LEGAL", True), ("o", 5, "LEGAL", True), ("o", 9, "LEGAL", True), ("o", 12, "LEGAL", True), ("o", 13, "REPEAT", True),
                   ("o", 14, "LEGAL", True), ("o", 20, "ILLEGAL", True), ("x", 2, "ILLEGAL", False), ("x", 3, "LEGAL", False)]


def test_current_order_prefers_the_open_one(spark):
    data = [order(1, "PENDING", created=1), order(2, "PAID", created=9), order(3, "PAID", "v", created=1), order(4, "FAILED", "v", created=2)]
    assert rows(orders.current_order(spark.createDataFrame(data, ORDERS)), "user_id", "order_id") == [("u", 1), ("v", 4)]


def test_list_keeps_the_newest(spark):
    df = spark.createDataFrame([order(i, created=i) for i in range(130)], ORDERS)
    kept = orders.order_list(df)
    assert kept.count() == 100 and kept.agg(F.min("created_s")).first()[0] == 30


def test_details_take_the_latest_reason_by_seq(spark):
    history = spark.createDataFrame([(1, 2, "B", "late"), (1, 1, "A", None), (2, 1, None, None)],
                                    "order_id int, seq bigint, reason string, reason_detail string")
    out = orders.order_details(spark.createDataFrame([order(1), order(2), order(3)], ORDERS), plans(spark), history)
    assert rows(out, "order_id", "reason", "reason_detail", "plan_type") == [(1, "B", "late", "FIXED"), (2, None, None, "FIXED"), (3, None, None, "FIXED")]
    assert [r["seq"] for r in orders.order_history(history, 1).collect()] == [2, 1]


def test_reconciliation_table(spark):
    cases = {1: ("success", None, 100), 2: ("success", None, 500), 3: ("success", None, None), 4: ("error", None, 100), 5: ("revert", None, 100),
             6: ("cancelled", None, 100), 7: ("canceled", None, 100), 8: (None, "ERROR_NOT_FOUND", None), 9: ("draft", None, None),
             10: ("draft", None, None), 11: ("mystery", None, None), 12: (None, "TIMEOUT", None)}
    data = [order(i, expires=NOW if i in (10, 12) else 2000) for i in cases] + [
        order(13), order(14, uuid=False, expires=NOW), order(15, uuid=False), order(16, amount=D("1.001")), order(17, "EXPIRED")]
    payments = [(f"p{i}", *c, "card declined") for i, c in cases.items()] + [("p16", "success", None, 100, ""), ("p17", "success", None, 100, "")]
    answers = spark.createDataFrame(payments, "provider_uuid string, raw_status string, error_code string, total_minor bigint, provider_text string")
    out = orders.reconcile(spark.createDataFrame(data, ORDERS), answers, NOW)
    fine, expire = ("NONE", None, None), ("EXPIRE", "INVOICE_EXPIRED", None)
    assert {r[0]: tuple(r[1:]) for r in rows(out)} == {
        1: ("GRANT", "RECONCILED_GRANT", None), 2: ("FAIL", "AMOUNT_MISMATCH", "reconciliation: provider=500 expected=100"),
        3: ("FAIL", "AMOUNT_MISMATCH", "reconciliation: provider=null expected=100"), 4: ("FAIL", "PROVIDER_ERROR", "card declined"),
        5: ("REVERT", "PROVIDER_REVERT", None), 6: expire, 7: expire, 8: expire, 9: fine, 10: expire, 11: fine, 12: fine, 13: fine, 14: expire,
        15: fine, 16: ("NONE", None, "amount not exact")}


def signed(store, invoice, amount, secret):
    return hashlib.md5("".join("null" if x is None else str(x) for x in (store, invoice, amount)).encode() + secret.encode()).hexdigest()


def test_callbacks_in_the_order_of_checks(spark):
    def call(i, uuid, amount=100, ip="1.1.1.1", secret="k", invoice="7", upper=False, sign=True):
        s = signed("s", invoice, amount, secret) if sign else None
        return (i, "s", amount, invoice, uuid, s.upper() if upper else s, ip)

    data = [call(1, "p1"), call(2, "p1", ip="9.9.9.9", secret="bad"), call(3, "p1", secret="bad"), call(4, "ghost"), call(5, "p5", amount=9),
            call(6, "p1", amount=9), call(7, "p7"), call(8, "p8"), call(9, "p9"), call(10, "p1", invoice=None, upper=True), call(11, "p1", sign=False),
            call(12, "p1", amount=None)]
    callbacks = spark.createDataFrame(data, "callback_id int, store_id string, amount bigint, invoice_id string, uuid string, sign string, source_ip string")
    known = spark.createDataFrame([order(1), order(5, "PAID"), order(7, "REVERTED"), order(8, "CREATED"), order(9, "EXPIRED")], ORDERS)
    secrets = spark.createDataFrame([("k",)], "secret string")
    out = orders.callback_audit(callbacks, known, secrets, "1.1.1.1")
    assert {r[0]: tuple(r[1:]) for r in rows(out, "callback_id", "outcome", "reason", "grants")} == {
        1: ("OK", None, True), 2: ("BAD_SOURCE", None, False), 3: ("BAD_SIGN", None, False), 4: ("REJECT", "UNKNOWN_ORDER", False),
        5: ("OK", None, False), 6: ("REJECT", "AMOUNT_MISMATCH", False), 7: ("OK", None, False), 8: ("RETRY", None, False), 9: ("OK", None, True),
        10: ("OK", None, True), 11: ("BAD_SIGN", None, False), 12: ("REJECT", "AMOUNT_MISMATCH", False)}


def test_the_secret_is_in_no_plan(spark):
    secrets = spark.createDataFrame([("very-hidden",)], "secret string")
    callbacks = spark.createDataFrame([(1, "s", 1, "7", "p1", "x", "ip")],
                                      "callback_id int, store_id string, amount bigint, invoice_id string, uuid string, sign string, source_ip string")
    out = orders.callback_audit(callbacks, spark.createDataFrame([order(1)], ORDERS), secrets, "ip")
    out.collect()
    assert "very-hidden" not in out._jdf.queryExecution().toString()


def test_one_grant_per_order(spark):
    status = {1: "PENDING", 2: "PAID", 3: "REVERTED", 4: "EXPIRED", 5: "CREATED", 6: "CANCELED"}
    signals = [(10, 1, "RECONCILIATION", 7), (11, 1, "CALLBACK", 5), (12, 1, "CALLBACK", 6), (20, 2, "CALLBACK", 1), (30, 3, "CALLBACK", 1),
               (40, 4, "RECONCILIATION", 1), (41, 4, "CALLBACK", 2), (50, 5, "CALLBACK", 1), (51, 5, "RECONCILIATION", 1), (60, 6, "CALLBACK", 1),
               (70, 7, "CALLBACK", 1), (42, 4, "RECONCILIATION", 20), (43, 4, "CALLBACK", 21)]
    df = spark.createDataFrame(signals, "signal_id int, order_id int, source string, at_s bigint")
    known = spark.createDataFrame([order(i, s) for i, s in status.items()], ORDERS).withColumn("granted_seconds", F.lit(60).cast("bigint"))
    grants, verdicts = orders.grants_from_success(df, known)
    assert dict(rows(verdicts, "signal_id", "verdict")) == {
        10: "ALREADY_GRANTED", 11: "GRANT", 12: "ALREADY_GRANTED", 20: "SKIP_PAID", 30: "REFUSE_REVERTED", 40: "NO_RESCUE", 41: "GRANT", 50: "ILLEGAL",
        51: "NO_RESCUE", 60: "GRANT", 70: "UNKNOWN_ORDER", 42: "ALREADY_GRANTED", 43: "ALREADY_GRANTED"}
    assert rows(grants, "grant_id", "granted_seconds", "paid") == [("order-1", 60, True), ("order-4", 60, True), ("order-6", 60, True)]


def test_decisions(spark):
    asked = [(1, "new", "CREATE", "weekly", "UZS"), (2, "same", "CREATE", "weekly", "uzs"), (3, "stale", "CREATE", "weekly", "UZS"),
             (4, "other", "CREATE", "monthly", "UZS"), (5, "paid", "CREATE", "weekly", "UZS"), (6, "topup", "CREATE", "pay_as_you_go", "UZS"),
             (7, "lost", "CREATE", "gold", "UZS"), (8, "off", "CREATE", "yearly", "UZS"), (9, "usd", "CREATE", "monthly", "USD"),
             (10, "cancel", "CANCEL", None, None), (11, "empty", "CANCEL", None, None), (12, "done", "CANCEL", None, None), (13, "new", "CREATE", "weekly", "UZS"),
             (14, "minus", "CREATE", "pay_as_you_go", "UZS"), (15, "fine", "CREATE", "pay_as_you_go", "UZS"), (16, "again", "CREATE", "pay_as_you_go", "UZS")]
    amounts = {6: D(8000), 14: D(-5), 15: D("0.001"), 16: D(-5)}
    requests = spark.createDataFrame([(*a, a[0], amounts.get(a[0])) for a in asked],
                                     "request_id int, user_id string, kind string, plan_code string, currency string, asked_s int, amount decimal(38,18)")
    known = spark.createDataFrame([order(2, user="same"), order(3, user="stale", expires=NOW), order(4, user="other"), order(10, user="cancel"),
                                   order(14, user="minus"), order(16, user="again", plan="pay_as_you_go"), order(12, "PAID", "done")], ORDERS)
    blocked = spark.createDataFrame([("paid", True), ("topup", True), ("new", False)], "user_id string, blocked boolean")
    out = orders.order_decision(requests, known, plans(spark), prices(spark), blocked, NOW)
    assert {r[0]: tuple(r[1:]) for r in rows(out, "request_id", "decision", "error", "current_order_id")} == {
        1: ("CREATE", None, None), 2: ("REUSE", None, 2), 3: ("EXPIRE_AND_CREATE", None, 3), 4: ("SUPERSEDE_AND_CREATE", None, 4),
        5: ("REJECT", "ALREADY_SUBSCRIBED", None), 6: ("CREATE", None, None), 7: ("REJECT", "UNKNOWN_PLAN", None), 8: ("REJECT", "UNKNOWN_PLAN", None),
        9: ("REJECT", "NO_PRICE", None), 10: ("CANCEL", None, 10), 11: ("REJECT", "NO_ORDERS", None), 12: ("REJECT", "NOT_PENDING", None),
        13: ("WAIT", None, None), 14: ("REJECT", "AMOUNT_NOT_POSITIVE", None), 15: ("REJECT", "TOO_MANY_DECIMALS", None), 16: ("REUSE", None, 16)}


def test_terms(spark):
    accepted = spark.createDataFrame([(1, "u", "monthly", "uzs", D(5)), (2, "u", "pay_as_you_go", "UZS", D("8000.01")), (3, "u", "pay_as_you_go", "UZS", D("0.001")),
                                      (4, "u", "pay_as_you_go", "UZS", None)],
                                     "request_id int, user_id string, plan_code string, currency string, amount decimal(38,18)")
    out = orders.order_terms(accepted, plans(spark), prices(spark), NOW)
    assert rows(out, "request_id", "days", "granted_seconds", "amount", "error", "expires_s") == [
        (1, 30, 2_592_000, D("150000.000000000000000000"), None, 2800), (2, 2, 172_800, D("8000.010000000000000000"), None, 2800),
        (3, None, None, D("0.001000000000000000"), "TOO_MANY_DECIMALS", 2800), (4, None, None, None, "AMOUNT_NOT_POSITIVE", 2800)]


def test_constraints(spark):
    users = spark.createDataFrame([("u", "USER"), ("u", "KING")], "user_id string, role string")
    rules = spark.createDataFrame([("u", "A", "SPOT", 1), ("u", "A", "SPOT", 1), ("ghost", "A", "SPOT", 1)], "user_id string, symbol string, market string, tier_no int")
    bad_plans = spark.createDataFrame([("weekly", "FIXED", None, True), ("weekly", "ODD", 3, True)], "code string, type string, duration_days int, active boolean")
    known = spark.createDataFrame([order(1), order(2, "CREATED"), order(2, "LOST", amount=D(-1)), order(3, "PAID", "ghost", "gold", uuid=False)], ORDERS)
    history = spark.createDataFrame([(1,), (9,), (9,)], "order_id int")
    got = dict(rows(orders.constraint_audit(users, rules, bad_plans, prices(spark), known, history)))
    assert {k: v for k, v in got.items() if v} == {
        "users_unique": 1, "users_role": 1, "rules_unique_tier": 1, "rules_user": 1, "plans_unique_code": 1, "plans_type": 1, "plans_duration": 2,
        "prices_plan": 4, "orders_unique": 1, "orders_status": 1, "orders_amount": 1, "orders_one_open": 1, "orders_provider_uuid": 1, "orders_user": 1,
        "orders_plan": 1, "history_order": 2}


def test_directory_pages(spark):
    users = spark.createDataFrame([(i, "ADMIN" if i == 29 else "USER", i) for i in range(30)], "user_id int, role string, created_s bigint")
    facts = spark.createDataFrame([(29, NOW + 5, True), (28, NOW, True), (27, NOW + 1, True), (26, NOW + 1, False)], "user_id int, expires_s bigint, has_paid boolean")
    first = orders.user_directory(users, facts, NOW, -3, 0).collect()
    assert [r["user_id"] for r in first] == list(range(29, 9, -1))
    assert [(r["state"], r["expires_s"]) for r in first[:5]] == [("ADMIN", NOW + 5), ("EXPIRED", NOW), ("ACTIVE", NOW + 1), ("TRIAL", NOW + 1), ("EXPIRED", None)]
    assert orders.user_directory(users, facts, NOW, 1, 20).count() == 10
    assert orders.directory_totals(users, 7).first()["total_pages"] == 5


def test_deep_pages_sort_one_range(spark):
    days = spark.range(40_000).select(F.col("id").alias("user_id"), F.lit("USER").alias("role"), (F.col("id") * 8640 % 40_000_000).alias("created_s"))
    want = [r.user_id for r in days.orderBy(F.desc("created_s"), "user_id").collect()]
    for first in (0, 15, 19_990, 39_995, 50_000):
        found = orders.page_of_users(days, first, 20)
        assert [r.user_id for r in found.orderBy("place").collect()] == want[first:first + 20]
    most = days.groupBy(F.expr("created_s div 86400")).count().agg(F.max("count")).first()[0]
    plan = orders.page_of_users(days, 10_000, 20)._jdf.queryExecution().executedPlan().toString()
    assert most < 200 and "row_number() windowspecdefinition(__range" in plan and "TakeOrdered" not in plan
    nulls = spark.createDataFrame([(1, 5), (2, None), (3, None), (4, 90_000)], "user_id int, created_s bigint")
    assert [r.user_id for r in orders.page_of_users(nulls, 0, 9).orderBy("place").collect()] == [4, 1, 2, 3]


def test_an_earlier_event_changes_what_the_next_one_meets(spark):
    known = spark.createDataFrame([order(1), order(2), order(3, "EXPIRED"), order(4, "CREATED")], ORDERS)
    calls = [(i, "s", str(o), f"p{o}", 100, "ip", at) for i, (o, at) in enumerate([(1, 30), (1, 40), (2, 10), (3, 5), (4, 5)])]
    sign = lambda o: hashlib.md5(f"s{o}100k".encode()).hexdigest()
    callbacks = spark.createDataFrame([(i, s, o, u, a, ip, sign(o), at) for i, s, o, u, a, ip, at in calls],
                                      "callback_id int, store_id string, invoice_id string, uuid string, amount bigint, source_ip string, sign string, at_s bigint")
    sweeps = spark.createDataFrame([("a", "p1", "error", None, 100, 20), ("b", "p1", "success", None, 100, 50), ("c", "p2", "revert", None, 100, 20), ("d", "p3", "success", None, 100, 1)],
                                   "sweep_id string, provider_uuid string, raw_status string, error_code string, total_minor bigint, at_s bigint")
    log = orders.payment_log(callbacks, sweeps, known, spark.createDataFrame([("k",)], "secret string"), "ip")
    assert rows(log, "order_id", "at_s", "before", "action", "after", "grants") == [
        (1, 20, "PENDING", "FAIL", "FAILED", False), (1, 30, "FAILED", "GRANT", "PAID", True), (1, 40, "PAID", "OK", "PAID", False), (1, 50, "PAID", "NONE", "PAID", False),
        (2, 10, "PENDING", "GRANT", "PAID", True), (2, 20, "PAID", "NONE", "PAID", False), (3, 1, "EXPIRED", "NONE", "EXPIRED", False), (3, 5, "EXPIRED", "GRANT", "PAID", True),
        (4, 5, "CREATED", "RETRY", "CREATED", False)]
