from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from depthspark.operators import access
from tests import models
from tests.conftest import rows

NOW = datetime(2026, 7, 18, 12, tzinfo=timezone.utc)
DAY = timedelta(days=1)
FACTS = "user_id string, access_expires_at timestamp, has_paid boolean"


@pytest.mark.parametrize("block_days", [1, 30, 100_000])
def test_grants_stack_like_the_sequential_rule(spark, block_days):
    rng, data, expected = random.Random(block_days), [], []
    for user in range(40):
        at, grants = 1_700_000_000, []
        for _ in range(rng.randint(1, 25)):
            at += rng.choice([60, 3600, 86_400 * 3, 86_400 * 40])
            grants.append((at, rng.choice([3600, 86_400, 86_400 * 30])))
        for n, ((start, seconds), (before, after)) in enumerate(zip(grants, models.fold(grants))):
            data.append((f"{user}-{n:03d}", user, start, seconds, "ADMIN"))
            expected.append((f"{user}-{n:03d}", before, after))
    df = spark.createDataFrame(data, "grant_id string, user_id int, s bigint, granted_seconds bigint, source string").withColumn(
        "granted_at", F.timestamp_seconds("s"))
    out = access.fold_grants(df, block_days).select(
        "grant_id", F.unix_seconds("previous_expires_at"), F.unix_seconds("new_expires_at"))
    assert rows(out) == sorted(expected)


def test_a_trial_then_a_purchase(spark):
    users = spark.createDataFrame([("u", NOW - 10 * DAY)], "user_id string, created_at timestamp")
    grants = access.trial_grants(users).unionByName(spark.createDataFrame(
        [("p", "u", NOW, 7 * 86_400, "PURCHASE"), ("q", "u", NOW + DAY, 86_400, "ADMIN")],
        "grant_id string, user_id string, granted_at timestamp, granted_seconds bigint, source string"))
    ledger = access.fold_grants(grants)
    ends = [r["new_expires_at"].replace(tzinfo=timezone.utc) for r in ledger.orderBy("granted_at").collect()]
    assert ends == [NOW - 3 * DAY, NOW + 7 * DAY, NOW + 8 * DAY]
    now = access.current_entitlement(ledger).first()
    assert now["has_paid"] and now["access_expires_at"].replace(tzinfo=timezone.utc) == NOW + 8 * DAY


def facts(spark):
    return spark.createDataFrame([("paid", NOW + DAY, True), ("trial", NOW + DAY, False), ("edge", NOW, True), ("none", None, True),
                                  ("admin", NOW + 99 * DAY, True), ("later", NOW + 5 * DAY, True), ("blocked", NOW + 5 * DAY + timedelta(seconds=1), True)], FACTS)


def people(spark):
    names = ["paid", "trial", "edge", "none", "admin", "later", "blocked", "unknown"]
    return spark.createDataFrame([(n, "ADMIN" if n == "admin" else "USER") for n in names], "user_id string, role string")


def test_states(spark):
    out = access.access_state(people(spark), facts(spark), NOW)
    assert dict(rows(out, "user_id", "state")) == {
        "paid": "ACTIVE", "trial": "TRIAL", "edge": "EXPIRED", "none": "EXPIRED", "admin": "ADMIN", "later": "ACTIVE", "blocked": "ACTIVE",
        "unknown": "EXPIRED"}
    assert out.filter("user_id = 'admin'").first()["access_expires_at"] is None


def test_access_and_renewal(spark):
    has = dict(rows(access.has_access(people(spark), facts(spark), NOW), "user_id", "has_access"))
    assert {k for k, v in has.items() if v} == {"paid", "trial", "admin", "later", "blocked"}
    blocked = dict(rows(access.renewal_blocked(people(spark), facts(spark), NOW), "user_id", "blocked"))
    assert {k for k, v in blocked.items() if v} == {"blocked"}


def test_gifts_are_all_or_nothing(spark):
    asked = [(1, "a", 3), (1, "a", 3), (1, "b", 3), (2, "a", 1), (2, "ghost", 1), (3, "a", 0)]
    requests = spark.createDataFrame([(*r, "boss") for r in asked], "request_id int, user_id string, days int, admin_id string")
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    grants, verdicts = access.gift_grants(requests, users, NOW)
    assert rows(grants, "request_id", "user_id", "granted_seconds", "paid", "admin_id") == [
        (1, "a", 259_200, False, "boss"), (1, "b", 259_200, False, "boss")]
    assert dict(rows(verdicts, "request_id", "verdict")) == {1: "OK", 2: "UNKNOWN_USER", 3: "BAD_DAYS"}


def test_history_nests_the_paying_order(spark):
    ledger = spark.createDataFrame([("g1", "u", NOW, "TRIAL", None), ("g2", "u", NOW + DAY, "PURCHASE", "o1")],
                                   "grant_id string, user_id string, granted_at timestamp, source string, order_id string")
    details = spark.createDataFrame([("o1", "PAID")], "order_id string, status string")
    first, second = access.access_history(ledger, details).orderBy("user_id", F.desc("granted_at"), F.desc("grant_id")).collect()
    assert first["order"]["status"] == "PAID" and second["order"] is None
