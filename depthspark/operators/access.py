"""Access from an append-only list of grants. Times are timestamps, durations whole seconds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthspark.operators import scan

TRIAL_SECONDS = 7 * 86_400
RENEWAL_SECONDS = 5 * 86_400
_DAY = 86_400_000_000


def as_instant(as_of: datetime) -> Column:
    return F.timestamp_micros(F.lit(int(as_of.timestamp() * 1_000_000)))


def fold_grants(grants: DataFrame, block_days: int = 1) -> DataFrame:
    """Ledger rows: ``new = max(granted_at, previous) + seconds``, per user in order of time.

    ``grants`` has ``grant_id, user_id, granted_at, granted_seconds`` and whatever else should be kept.
    With S the running sum of seconds and M the running maximum of ``granted_at - S before it``, the
    expiry is ``S + M``. A block of days starting from expiry E ends at ``max(E + its sum, its own S + M)``;
    that is the same rule again, one level up, so each user is folded per block and the blocks are
    folded by two more window sums. No user's whole history is one group.
    """
    micros = F.unix_micros(F.col("granted_at").cast("timestamp"))
    timed = grants.withColumns({"__at": micros, "__len": F.col("granted_seconds") * 1_000_000})
    cut = scan.cut_blocks(timed, ["user_id"], "__at", block_days * _DAY)
    inside = Window.partitionBy("user_id", "__block").orderBy("__at", "grant_id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = (cut.withColumn("__s", F.sum("__len").over(so_far))
             .withColumn("__m", F.max(F.col("__at") - F.col("__s") + F.col("__len")).over(so_far))
             .withColumn("__before", F.lag(F.struct("__s", "__m")).over(inside)))

    blocks = Window.partitionBy("user_id").orderBy("__block")
    upto = blocks.rowsBetween(Window.unboundedPreceding, 0)
    carried = (scan.per_block(local, ["user_id"], F.sum("__len").alias("__sum"), F.max("__m").alias("__top"))
               .withColumn("__cs", F.sum(scan.handed_on(F.col("__sum"))).over(upto))
               .withColumn("__end", F.col("__cs") + F.max(
                   F.col("__sum") + F.col("__top") - F.col("__cs")).over(upto))
               .select("user_id", "__block", F.lag("__end").over(blocks).alias("__in")))

    joined = local.join(carried, ["user_id", "__block"])
    after = F.greatest(F.col("__s") + F.col("__m"), F.col("__in") + F.col("__s"))
    before = F.when(F.col("__before").isNull(), F.col("__in")).otherwise(
        F.greatest(F.col("__before.__s") + F.col("__before.__m"), F.col("__in") + F.col("__before.__s")))
    return joined.select(*grants.columns, F.timestamp_micros(before).alias("previous_expires_at"),
                         F.timestamp_micros(after).alias("new_expires_at"))


def trial_grants(users: DataFrame, seconds: int = TRIAL_SECONDS) -> DataFrame:
    """The first grant of every user, at registration (``created_at``)."""
    return users.select(
        F.concat(F.lit("trial-"), F.col("user_id").cast("string")).alias("grant_id"), "user_id",
        F.col("created_at").alias("granted_at"), F.lit(seconds).cast("bigint").alias("granted_seconds"),
        F.lit("TRIAL").alias("source"))


def _paid(ledger: DataFrame) -> Column:
    return F.col("paid") if "paid" in ledger.columns else F.col("source") == "PURCHASE"


def current_entitlement(ledger: DataFrame) -> DataFrame:
    """Per user the last expiry, and whether any grant was paid."""
    order = F.struct(F.col("granted_at"), F.col("grant_id"))
    return ledger.groupBy("user_id").agg(
        F.max_by("new_expires_at", order).alias("access_expires_at"),
        F.max(_paid(ledger)).alias("has_paid"))


def gift_grants(requests: DataFrame, users: DataFrame, granted_at: datetime) -> tuple[DataFrame, DataFrame]:
    """``(grants, verdicts)`` of admin gifts.

    ``requests`` has ``request_id, user_id, days`` and may have ``admin_id, reason``. Users named twice get
    one gift; one unknown user, or days that are not positive, reject the whole request.
    """
    extra = [c for c in ("admin_id", "reason") if c in requests.columns]
    once = requests.dropDuplicates(["request_id", "user_id"])
    known = users.select("user_id").distinct().withColumn("__known", F.lit(True))
    checked = once.join(known, "user_id", "left")
    verdicts = checked.groupBy("request_id").agg(
        F.count_if(F.col("__known").isNull()).alias("unknown_users"),
        F.min("days").alias("__days"), F.count("*").alias("users"))
    bad_days = F.col("__days").isNull() | (F.col("__days") <= 0)
    verdicts = verdicts.select(
        "request_id", "users", "unknown_users",
        F.when(bad_days, "BAD_DAYS").when(F.col("unknown_users") > 0, "UNKNOWN_USER").otherwise("OK")
        .alias("verdict"))
    accepted = checked.join(verdicts.filter(F.col("verdict") == "OK").select("request_id"), "request_id",
                            "left_semi")
    grants = accepted.select(
        F.concat_ws("-", F.lit("gift"), F.col("request_id").cast("string"), F.col("user_id").cast("string"))
        .alias("grant_id"),
        "request_id", "user_id", as_instant(granted_at).alias("granted_at"),
        (F.col("days") * 86_400).cast("bigint").alias("granted_seconds"), F.lit("ADMIN").alias("source"),
        F.lit(False).alias("paid"), *extra)
    return grants, verdicts


def _facts(users: DataFrame, entitlement: DataFrame) -> DataFrame:
    return users.join(entitlement.select("user_id", "access_expires_at", "has_paid"), "user_id", "left")


def access_state(users: DataFrame, entitlement: DataFrame, as_of: datetime) -> DataFrame:
    """ADMIN, EXPIRED, ACTIVE or TRIAL; access ends at the very moment of expiry."""
    df = _facts(users, entitlement)
    now, expires = as_instant(as_of), F.col("access_expires_at")
    admin = F.col("role") == "ADMIN"
    state = (F.when(admin, "ADMIN").when(expires.isNull() | (now >= expires), "EXPIRED")
             .when(F.col("has_paid"), "ACTIVE").otherwise("TRIAL"))
    return df.select(*users.columns, state.alias("state"),
                     F.when(~admin, expires).alias("access_expires_at"))


def has_access(users: DataFrame, entitlement: DataFrame, as_of: datetime) -> DataFrame:
    open_now = (F.col("role") == "ADMIN") | F.coalesce(as_instant(as_of) < F.col("access_expires_at"), F.lit(False))
    return _facts(users, entitlement).select(*users.columns, open_now.alias("has_access"))


def renewal_blocked(users: DataFrame, entitlement: DataFrame, as_of: datetime,
                    window_seconds: int = RENEWAL_SECONDS) -> DataFrame:
    """True for a paid user whose access ends strictly later than the renewal window."""
    limit = F.timestamp_micros(F.lit(int(as_of.timestamp() * 1_000_000) + window_seconds * 1_000_000))
    blocked = ((F.col("role") != "ADMIN") & F.coalesce("has_paid", F.lit(False))
               & F.coalesce(F.col("access_expires_at") > limit, F.lit(False)))
    return _facts(users, entitlement).select(*users.columns, blocked.alias("blocked"))


def access_history(ledger: DataFrame, order_details: DataFrame) -> DataFrame:
    """Ledger rows, with the paying order as a struct (null for trial and gift)."""
    orders = order_details.select(
        F.col("order_id"), F.struct(*order_details.columns).alias("order"))
    paying = ledger.withColumn("order_id", F.when(_paid(ledger), F.col("order_id")))
    return paying.join(orders, "order_id", "left")
