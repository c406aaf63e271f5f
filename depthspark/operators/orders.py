"""Orders and payments: reads, audits, reconciliation, callbacks and order decisions.

Orders have ``order_id, user_id, status, plan_code, amount (decimal), currency, provider_uuid,
expires_s, created_s``; seconds are since 1970.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthspark.functions import currency as cur
from depthspark.functions import payments as pay
from depthspark.operators import scan

HISTORY_ROWS = 100
INVOICE_SECONDS = 30 * 60
SECONDS_PER_DAY = 86_400
PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
RANGE_S = 86_400      # users are counted per day of their creation


# --- reads -------------------------------------------------------------------------------------


def order_details(orders: DataFrame, plans: DataFrame, history: DataFrame) -> DataFrame:
    """Orders with their plan's name and the reason of their latest step by ``seq``."""
    cols = ["reason"] + [c for c in ("reason_detail",) if c in history.columns]
    latest = history.groupBy("order_id").agg(F.max_by(F.struct(*cols), "seq").alias("__last"))
    named = plans.select(F.col("code").alias("plan_code"), F.col("type").alias("plan_type"))
    return (orders.join(latest, "order_id", "left").join(named, "plan_code", "left")
            .select(*orders.columns, "plan_type", *[F.col(f"__last.{c}").alias(c) for c in cols]))


def order_list(details: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """The newest ``n`` orders per user, with their place."""
    return scan.best_rows(details, ["user_id"], [F.desc("created_s"), F.desc("order_id")], n, "place")


def current_order(orders: DataFrame) -> DataFrame:
    """Per user the open order, else the newest."""
    newest = F.struct(pay.is_open(F.col("status")).alias("open"), "created_s", "order_id")
    row = F.struct(*[c for c in orders.columns if c != "user_id"])
    return (orders.groupBy("user_id").agg(F.max_by(row, newest).alias("__row"))
            .select("user_id", "__row.*").select(*orders.columns))


def order_history(history: DataFrame, order_id) -> DataFrame:
    """Steps of one order, newest first."""
    return history.filter(F.col("order_id") == order_id).orderBy(F.desc("seq"))


def transition_audit(history: DataFrame) -> DataFrame:
    """Adds ``verdict`` (LEGAL, ILLEGAL, REPEAT) and ``chained``: the step starts where the last ended.

    A plain window per order: an order has a few steps, so no order is hot.
    """
    seen = history.withColumn("prev_to_status", F.lag("to_status").over(Window.partitionBy("order_id").orderBy("seq")))
    before, after = F.col("from_status"), F.col("to_status")
    verdict = (F.when(before == after, "REPEAT").when(pay.allowed(before, after), "LEGAL").otherwise("ILLEGAL"))
    return (seen.withColumns({"verdict": verdict, "chained": before.eqNullSafe(F.col("prev_to_status"))})
            .drop("prev_to_status"))


def page_of_users(users: DataFrame, first: int, size: int, range_s: int = RANGE_S) -> DataFrame:
    """The users at places ``first`` to ``first + size - 1``, newest first, with their ``place``.

    Users are counted per range of ``range_s`` seconds of their creation; the running counts tell which ranges hold the page, and
    only these are sorted, each by itself. So a page far down costs what the first one does: no task sorts, or holds,
    more than one range. Users without a creation time come last, as one range.
    """
    ranged = users.withColumn("__range", scan.block_of("created_s", range_s))
    newest = Window.orderBy(F.desc_nulls_last("__range"))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(newest))
    held = counts.filter((F.col("__upto") > first) & (F.col("__upto") - F.col("__n") < first + size))
    rows = ranged.join(held, ranged["__range"].eqNullSafe(held["__range"])).drop(held["__range"])
    inside = Window.partitionBy("__range").orderBy(F.desc_nulls_last("created_s"), F.asc("user_id"))
    place = F.col("__upto") - F.col("__n") + F.row_number().over(inside) - 1
    return (rows.withColumn("place", place).filter((F.col("place") >= first) & (F.col("place") < first + size))
            .select(*users.columns, "place"))


def user_directory(users: DataFrame, entitlement: DataFrame, as_of_s: int, page: int = 0,
                   size: int = PAGE_SIZE) -> DataFrame:
    """One page of users, newest first, with access state; the expiry is shown for admins too.

    ``entitlement`` has ``user_id, expires_s, has_paid``. The page is located and cut before the join (``page_of_users``).
    """
    size = PAGE_SIZE if size <= 0 else min(size, MAX_PAGE_SIZE)
    order = [F.desc("created_s"), F.asc("user_id")]
    shown = page_of_users(users, max(page, 0) * size, size)
    expires = F.col("expires_s")
    state = (F.when(F.col("role") == "ADMIN", "ADMIN")
             .when(expires.isNull() | (F.lit(as_of_s) >= expires), "EXPIRED")
             .when(F.col("has_paid"), "ACTIVE").otherwise("TRIAL"))
    return (shown.join(entitlement, "user_id", "left")
            .select(*users.columns, state.alias("state"), "expires_s",
                    F.coalesce("has_paid", F.lit(False)).alias("has_paid"))
            .orderBy(*order))


def directory_totals(users: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    size = PAGE_SIZE if size <= 0 else min(size, MAX_PAGE_SIZE)
    return users.agg(F.count("*").alias("total_users")).withColumn(
        "total_pages", F.expr(f"(total_users + {size - 1}) div {size}"))


# --- provider and callbacks --------------------------------------------------------------------


def map_provider_status(payments: DataFrame) -> DataFrame:
    return payments.withColumn("status", pay.provider_status(F.col("raw_status"), F.col("error_code")))


def _stale(as_of_s: int) -> Column:
    return F.coalesce(F.col("expires_s") <= as_of_s, F.lit(False))


def _sweep_verdict(df: DataFrame, answer: Column, paid: Column, expected: Column, text: Column, stale: Column) -> DataFrame:
    """Adds ``action``, ``reason`` and ``detail`` of a sweep that finds the order PENDING."""
    success = answer == "SUCCESS"
    inexact = success & expected.isNull()
    mismatch = success & (paid.isNull() | (paid != expected))
    timed_out = stale & (F.col("provider_uuid").isNull() | (answer == "PENDING"))
    rules = [
        (inexact, "NONE", None),
        (mismatch, "FAIL", "AMOUNT_MISMATCH"),
        (success, "GRANT", "RECONCILED_GRANT"),
        (answer == "ERROR", "FAIL", "PROVIDER_ERROR"),
        (answer == "REVERT", "REVERT", "PROVIDER_REVERT"),
        (answer.isin("CANCELED", "NOT_FOUND"), "EXPIRE", "INVOICE_EXPIRED"),
        (timed_out, "EXPIRE", "INVOICE_EXPIRED"),
    ]
    action, reason = F.lit("NONE"), F.lit(None).cast("string")
    for condition, what, why in reversed(rules):
        hit = F.coalesce(condition, F.lit(False))
        action = F.when(hit, F.lit(what)).otherwise(action)
        reason = F.when(hit, F.lit(why)).otherwise(reason)
    shown = F.coalesce(paid.cast("string"), F.lit("null"))
    detail = (F.when(inexact, "amount not exact")
              .when(mismatch, F.concat(F.lit("reconciliation: provider="), shown, F.lit(" expected="),
                                       expected.cast("string")))
              .when(answer == "ERROR", text))
    return df.withColumns({"action": action, "reason": reason, "detail": detail})


def _answers(payments: DataFrame, *more: str) -> DataFrame:
    text = F.col("provider_text") if "provider_text" in payments.columns else F.lit(None).cast("string")
    return map_provider_status(payments).select(
        F.col("provider_uuid").alias("__uuid"), F.col("status").alias("__status"), "total_minor", text.alias("__text"), *more)


def reconcile(orders: DataFrame, payments: DataFrame, as_of_s: int) -> DataFrame:
    """What a sweep does with every PENDING order, from the provider's answers.

    ``payments`` has one row per fetched uuid: ``provider_uuid, raw_status, error_code, total_minor`` and
    maybe ``provider_text``. Orders without an answer are left for the next sweep.
    """
    df = (orders.filter(F.col("status") == "PENDING")
          .withColumn("__expected", cur.minor_units(F.col("amount")))
          .join(_answers(payments), F.col("provider_uuid") == F.col("__uuid"), "left"))
    judged = _sweep_verdict(df, F.col("__status"), F.col("total_minor"), F.col("__expected"), F.col("__text"), _stale(as_of_s))
    return judged.select("order_id", "action", "reason", "detail")


def payment_log(callbacks: DataFrame, sweeps: DataFrame, orders: DataFrame, secrets: DataFrame, allowed_ip: str) -> DataFrame:
    """Every callback and every sweep of an order in order of time, with the state it met and what it did.

    ``callbacks`` have ``callback_id, at_s`` and what ``callback_audit`` needs; ``sweeps`` have ``sweep_id, at_s`` and a provider's answer,
    one row per fetch. Returns ``order_id, at_s, source, event_id, before, action, reason, after, grants``. A sweep moves PENDING orders
    only; a valid callback pays any order that is not CREATED, PAID or REVERTED. So what an event meets follows from the first
    sweep before it that moved the order and from the valid callbacks before it: one window per order. At one time callbacks
    come first, then ids decide. Callbacks of unknown orders are left out; see ``callback_audit`` for them.
    """
    known = orders.select("order_id", "status", "provider_uuid", "expires_s", cur.minor_units(F.col("amount")).alias("__expected"))
    audited = callback_audit(callbacks, orders, secrets, allowed_ip).filter(F.col("order_id").isNotNull())
    called = (audited.join(known.select("order_id", F.col("status").alias("__first"), "__expected"), "order_id")
              .withColumn("__exact", F.coalesce(F.col("amount") == F.col("__expected"), F.lit(False)))
              .select("order_id", "at_s", F.lit("CALLBACK").alias("source"), F.col("callback_id").cast("string").alias("event_id"), "__first",
                      F.when(F.col("outcome").isin("BAD_SOURCE", "BAD_SIGN"), F.col("outcome"))
                      .when(F.col("__expected").isNull(), "INEXACT").when(~F.col("__exact"), "MISMATCH").otherwise("PAY").alias("__does"),
                      F.lit(None).cast("string").alias("__why")))
    asked = known.join(_answers(sweeps, "sweep_id", "at_s"), F.col("provider_uuid") == F.col("__uuid"))
    swept = _sweep_verdict(asked, F.col("__status"), F.col("total_minor"), F.col("__expected"), F.col("__text"), F.coalesce(F.col("expires_s") <= F.col("at_s"), F.lit(False)))
    swept = swept.select("order_id", "at_s", F.lit("RECONCILIATION").alias("source"), F.col("sweep_id").cast("string").alias("event_id"), F.col("status").alias("__first"),
                         F.col("action").alias("__does"), F.col("reason").alias("__why"))
    log = called.unionByName(swept)
    callback = F.col("source") == "CALLBACK"
    before = Window.partitionBy("order_id").orderBy("at_s", "source", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    pays = callback & (F.col("__does") == "PAY")
    moves = F.when(pays | (F.col("__does") == "GRANT"), "PAID").when(~callback, F.create_map(*[F.lit(x) for x in ("FAIL", "FAILED", "EXPIRE", "EXPIRED", "REVERT", "REVERTED")])[F.col("__does")])
    log = log.withColumns({"__move": F.first(moves, ignorenulls=True).over(before), "__paid": F.coalesce(F.max(pays).over(before), F.lit(False))})
    rescued = lambda state: F.when(F.col("__paid"), F.lit("PAID")).otherwise(state)
    met = (F.when(F.col("__first") == "PENDING", F.when(F.col("__move").isNull(), "PENDING").when(F.col("__move").isin("PAID", "REVERTED"), F.col("__move"))
                  .otherwise(rescued(F.col("__move"))))
           .when(F.col("__first").isin("EXPIRED", "FAILED", "CANCELED"), rescued(F.col("__first"))).otherwise(F.col("__first")))
    log = log.withColumn("before", met)
    status, does = F.col("before"), F.col("__does")
    grants = (pays & status.isin("PENDING", "EXPIRED", "FAILED", "CANCELED")) | (~callback & (does == "GRANT") & (status == "PENDING"))
    action = (F.when(does.isin("BAD_SOURCE", "BAD_SIGN"), does)
              .when(callback, F.when(grants, "GRANT").when(status == "PAID", "OK").when(does == "INEXACT", "RETRY").when(does == "MISMATCH", "REJECT")
                    .when(status == "CREATED", "RETRY").otherwise("OK"))
              .when(status == "PENDING", does).otherwise("NONE"))
    reason = (F.when(callback & grants, "CALLBACK_GRANT").when(callback & (action == "REJECT"), "AMOUNT_MISMATCH").when(~callback & (status == "PENDING"), F.col("__why")))
    after = F.when(grants, "PAID").when(~callback & (status == "PENDING"), F.coalesce(moves, status)).otherwise(status)
    return log.select("order_id", "at_s", "source", "event_id", "before", action.alias("action"), reason.alias("reason"), after.alias("after"), grants.alias("grants"))


def callback_audit(callbacks: DataFrame, orders: DataFrame, secrets: DataFrame, allowed_ip: str) -> DataFrame:
    """Outcome of each logged callback, in the order the checks are made.

    ``secrets`` is one row with ``secret``, read from a protected place; it enters as a scalar subquery,
    so its value is in no plan text.
    """
    secret = secrets.select(F.max("secret")).scalar()
    signed = F.lower("sign") == pay.signature(F.col("store_id"), F.col("invoice_id"), F.col("amount"), secret)
    known = orders.filter(F.col("provider_uuid").isNotNull()).select(
        F.col("provider_uuid").alias("__uuid"), F.col("order_id").alias("__order"),
        F.col("status").alias("__status"), cur.minor_units(F.col("amount")).alias("__expected"))
    df = callbacks.join(known, F.col("uuid") == F.col("__uuid"), "left")
    from_allowed = F.coalesce(F.col("source_ip") == allowed_ip, F.lit(False))
    matches = F.coalesce(F.col("amount") == F.col("__expected"), F.lit(False))
    rules = [
        (~from_allowed, "BAD_SOURCE", None),
        (~F.coalesce(signed, F.lit(False)), "BAD_SIGN", None),
        (F.col("__order").isNull(), "REJECT", "UNKNOWN_ORDER"),
        (F.col("__status") == "PAID", "OK", None),
        # An order amount that is not exact in minor units cannot be compared.
        (F.col("__expected").isNull(), "RETRY", None),
        (~matches, "REJECT", "AMOUNT_MISMATCH"),
        # An order that was never sent to the provider cannot become paid; the caller tries again.
        (F.col("__status") == "CREATED", "RETRY", None),
    ]
    outcome, reason = F.lit("OK"), F.lit(None).cast("string")
    for condition, what, why in reversed(rules):
        outcome = F.when(condition, F.lit(what)).otherwise(outcome)
        reason = F.when(condition, F.lit(why)).otherwise(reason)
    reached = F.col("__status").isin("PENDING", "EXPIRED", "FAILED", "CANCELED")
    grants = from_allowed & F.coalesce(signed, F.lit(False)) & reached & matches
    return df.select(*callbacks.columns, F.col("__order").alias("order_id"), outcome.alias("outcome"),
                     reason.alias("reason"), F.coalesce(grants, F.lit(False)).alias("grants"))


def grants_from_success(signals: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(grants, verdicts)``: one grant per order, for its first valid success signal.

    Once that signal is in, the order is paid: every later one is ALREADY_GRANTED, whatever its source. ``signals`` has ``signal_id, order_id, source (CALLBACK | RECONCILIATION), at_s``. The first valid
    signal is a partial aggregate, so replays of one order are cut down before the shuffle.
    """
    facts = orders.select("order_id", F.col("status").alias("__status"), "user_id",
                          F.col("granted_seconds") if "granted_seconds" in orders.columns
                          else F.lit(None).cast("bigint").alias("granted_seconds"))
    df = signals.join(facts, "order_id", "left")
    status, callback = F.col("__status"), F.col("source") == "CALLBACK"
    verdict = (F.when(status.isNull(), "UNKNOWN_ORDER").when(status == "PAID", "SKIP_PAID")
               .when(status == "REVERTED", "REFUSE_REVERTED").when(status == "PENDING", "GRANT")
               .when(~callback, "NO_RESCUE").when(status == "CREATED", "ILLEGAL").otherwise("GRANT"))
    judged = df.withColumn("verdict", verdict)
    first = (judged.filter(F.col("verdict") == "GRANT").groupBy("order_id")
             .agg(F.min(F.struct("at_s", "signal_id")).alias("__first")))
    told = judged.join(first, "order_id", "left").withColumn(
        "verdict", F.when(F.struct("at_s", "signal_id") > F.col("__first"), "ALREADY_GRANTED").otherwise(F.col("verdict")))
    grants = told.filter(F.col("verdict") == "GRANT").select(
        F.concat(F.lit("order-"), F.col("order_id").cast("string")).alias("grant_id"), "order_id", "user_id",
        F.timestamp_seconds("at_s").alias("granted_at"), "granted_seconds", F.lit("PURCHASE").alias("source"),
        F.lit(True).alias("paid"))
    return grants, told.select(*signals.columns, "verdict")


# --- order requests ----------------------------------------------------------------------------


def order_decision(requests: DataFrame, orders: DataFrame, plans: DataFrame, prices: DataFrame,
                   blocked: DataFrame, as_of_s: int) -> DataFrame:
    """Decision and error for each create or cancel request of a batch.

    ``requests`` has ``request_id, user_id, kind (CREATE | CANCEL), plan_code, currency, asked_s`` and, for plans
    paid by the day, ``amount (decimal)``. Only a user's first request is decided, the others WAIT for the
    next batch. A new order whose amount is bad is rejected as a whole, so an old one stays open. ``blocked`` has ``user_id,
    blocked`` (see ``access.renewal_blocked``).
    """
    first = requests.groupBy("user_id").agg(F.min(F.struct("asked_s", "request_id")).alias("__first"))
    active = plans.filter("active").select(F.col("code").alias("plan_code"), F.col("type").alias("__type"))
    price = (prices.filter("active")
             .select(F.col("code").alias("plan_code"), F.col("currency").alias("__code"),
                     F.lit(True).alias("__priced"), F.col("amount").alias("__price")))
    current = current_order(orders).select(
        "user_id", F.col("order_id").alias("current_order_id"), F.col("status").alias("__status"),
        F.col("plan_code").alias("__plan"), "expires_s")
    if "amount" not in requests.columns:
        requests = requests.withColumn("amount", F.lit(None).cast("decimal(38,18)"))
    df = (requests.withColumn("__code", cur.normal_code(F.col("currency")))
          .join(first, "user_id").join(active, "plan_code", "left")
          .join(price, ["plan_code", "__code"], "left")
          .join(current, "user_id", "left").join(blocked.select("user_id", "blocked"), "user_id", "left"))
    create, turn = F.col("kind") == "CREATE", F.col("request_id") == F.col("__first.request_id")
    open_now = F.coalesce(pay.is_open(F.col("__status")), F.lit(False))
    error = (F.when(create & F.col("__type").isNull(), "UNKNOWN_PLAN")
             .when(create & (F.col("__type") == "FIXED") & F.coalesce("blocked", F.lit(False)),
                   "ALREADY_SUBSCRIBED")
             .when(create & F.col("__priced").isNull(), "NO_PRICE")
             .when(~create & F.col("current_order_id").isNull(), "NO_ORDERS")
             .when(~create & (F.col("__status") != "PENDING"), "NOT_PENDING"))
    reuse = open_now & ~_stale(as_of_s) & (F.col("plan_code") == F.col("__plan"))
    error = F.coalesce(error, F.when(create & ~F.coalesce(reuse, F.lit(False)),
                                     _amount_error(F.col("__type") == "FIXED", F.col("amount"), F.col("__price"))))
    decision = (F.when(~turn, "WAIT").when(F.col("__error").isNotNull(), "REJECT").when(~create, "CANCEL")
                .when(~open_now, "CREATE").when(_stale(as_of_s), "EXPIRE_AND_CREATE")
                .when(F.col("plan_code") == F.col("__plan"), "REUSE").otherwise("SUPERSEDE_AND_CREATE"))
    return (df.withColumn("__error", F.when(turn, error)).withColumn("decision", decision)
            .select(*requests.columns, "decision", F.col("__error").alias("error"),
                    F.when(F.col("decision").isin("CANCEL", "EXPIRE_AND_CREATE", "REUSE", "SUPERSEDE_AND_CREATE"),
                           F.col("current_order_id")).alias("current_order_id")))


def _amount_error(fixed: Column, amount: Column, unit: Column) -> Column:
    return F.when(~fixed, F.when(amount.isNull() | (amount <= 0), "AMOUNT_NOT_POSITIVE")
                  .when(~cur.scale_ok(amount, F.col("__code")), "TOO_MANY_DECIMALS").when(unit <= 0, "PRICE_NOT_SET"))


def order_terms(accepted: DataFrame, plans: DataFrame, prices: DataFrame, as_of_s: int,
                ttl_seconds: int = INVOICE_SECONDS) -> DataFrame:
    """Days, granted seconds, amount and expiry of new orders; ``error`` where a per-day amount is bad.

    ``accepted`` has ``request_id, user_id, plan_code, currency, amount (decimal)``.
    """
    terms = plans.filter("active").select(F.col("code").alias("plan_code"), F.col("type").alias("__type"),
                                          "duration_days")
    price = prices.filter("active").select(
        F.col("code").alias("plan_code"), F.col("currency").alias("__code"), F.col("amount").alias("__price"))
    df = (accepted.withColumn("__code", cur.normal_code(F.col("currency")))
          .join(terms, "plan_code").join(price, ["plan_code", "__code"]))
    fixed, amount, unit = F.col("__type") == "FIXED", F.col("amount"), F.col("__price")
    error = _amount_error(fixed, amount, unit)
    days = F.when(fixed, F.col("duration_days").cast("bigint")).when(
        F.col("error").isNull(), cur.ceil_ratio(amount, unit))
    return (df.withColumn("error", error).withColumn("days", days)
            .select("request_id", "user_id", "plan_code", F.col("__code").alias("currency"), "days",
                    (F.col("days") * SECONDS_PER_DAY).alias("granted_seconds"),
                    F.when(fixed, unit).otherwise(amount).alias("amount"),
                    F.lit("CREATED").alias("status"), F.lit(as_of_s + ttl_seconds).alias("expires_s"), "error"))


# --- constraints -------------------------------------------------------------------------------


def _one(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint"), "violations")


def _bad_rows(df: DataFrame, **checks: Column) -> DataFrame:
    """All row checks of a table in one pass over it."""
    counted = df.agg(*[F.count_if(condition).alias(name) for name, condition in checks.items()])
    pairs = [F.struct(F.lit(name).alias("constraint"), F.col(name).alias("violations")) for name in checks]
    return counted.select(F.explode(F.array(*pairs)).alias("__p")).select("__p.*")


_PARENT = ""   # the rule name under which a parent's own key stands


class _Checks:
    """What one table adds to the audit: for each row its keys to be unique, its bad values, the keys it has and the keys it points to."""

    def __init__(self, df: DataFrame):
        self.df, self.found, self.rules = df, [], []

    def _add(self, space: str, rule: str, when: Column, *keys: str) -> _Checks:
        self.rules.append(rule)
        text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in keys]) if keys else F.lit("")
        self.found.append(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(space).alias("space"), text.alias("key"), F.lit(rule).alias("rule"))))
        return self

    def unique(self, rule: str, *keys: str, where: Column | None = None) -> _Checks:
        return self._add(f"unique {rule}", rule, F.lit(True) if where is None else where, *keys)

    def bad(self, **rules: Column) -> _Checks:
        for rule, condition in rules.items():
            self._add(f"bad {rule}", rule, condition)
        return self

    def filled(self, rule: str, *columns: str) -> _Checks:
        """Rows in which one of the columns that the table has is null."""
        missing = F.lit(False)
        for c in (c for c in columns if c in self.df.columns):
            missing = missing | F.col(c).isNull()
        return self.bad(**{rule: missing})

    def parent(self, name: str, key: str) -> _Checks:
        return self._add(f"key {name}", _PARENT, F.col(key).isNotNull(), key)

    def child(self, rule: str, column: str, parent: str) -> _Checks:
        return self._add(f"key {parent}", rule, F.col(column).isNotNull(), column)

    def names(self) -> list[str]:
        return [rule for rule in self.rules if rule != _PARENT]

    def rows(self) -> DataFrame:
        return self.df.select(F.explode(F.array_compact(F.array(*self.found))).alias("__c")).select("__c.*")


def constraint_audit(users: DataFrame, rules: DataFrame, plans: DataFrame, prices: DataFrame,
                     orders: DataFrame, history: DataFrame, ledger: DataFrame | None = None,
                     connections: DataFrame | None = None, entitlements: DataFrame | None = None) -> DataFrame:
    """Violations per constraint: duplicate keys, bad or missing values, and references that point nowhere.

    Duplicates are counted in keys, the rest in rows. Every table is read once: a row is expanded to one small row per constraint it
    takes part in, as grouping sets do. One shuffle on (space of keys, key) then decides all of them: a key that is there twice, or
    a key that is pointed to but that no parent has. Counts are summed before that shuffle, so a hot key is a few rows. ``users`` may
    have an ``email`` and ``ledger`` an ``admin_id``.
    """
    fixed, days = F.col("type") == "FIXED", F.col("duration_days").isNotNull()
    u = _Checks(users).unique("users_unique", "user_id").bad(users_role=~F.col("role").isin("USER", "ADMIN")).parent("users", "user_id")
    u.filled("users_not_null", "user_id", "role", *(["email"] if "email" in users.columns else []))
    if "email" in users.columns:
        u.unique("users_unique_email", "email", where=F.col("email").isNotNull())
    tables = [
        u,
        _Checks(rules).unique("rules_unique_tier", "user_id", "symbol", "market", "tier_no").child("rules_user", "user_id", "users")
        .filled("rules_not_null", "user_id", "symbol", "market", "tier_no", "min_notional", "max_distance"),
        _Checks(plans).unique("plans_unique_code", "code").bad(plans_type=~F.col("type").isin("FIXED", "PER_DAY"), plans_duration=fixed != days).parent("plans", "code"),
        _Checks(prices).unique("prices_unique", "code", "currency").bad(prices_amount=F.col("amount") < 0).child("prices_plan", "code", "plans"),
        _Checks(orders).unique("orders_unique", "order_id").bad(orders_status=~F.col("status").isin(*pay.STATUSES), orders_amount=F.col("amount") < 0)
        .unique("orders_one_open", "user_id", where=pay.is_open(F.col("status")))
        .unique("orders_provider_uuid", "provider_uuid", where=F.col("provider_uuid").isNotNull())
        .child("orders_user", "user_id", "users").child("orders_plan", "plan_code", "plans").parent("orders", "order_id")
        .filled("orders_not_null", "order_id", "user_id", "status", "amount"),
        _Checks(history).child("history_order", "order_id", "orders"),
    ]
    if ledger is not None:
        own = _Checks(ledger).child("ledger_user", "user_id", "users").child("ledger_order", "order_id", "orders").filled("ledger_not_null", "user_id", "source", "granted_seconds")
        tables.append(own.child("ledger_admin", "admin_id", "users") if "admin_id" in ledger.columns else own)
    if connections is not None:
        tables.append(_Checks(connections).child("connections_user", "user_id", "users"))
    if entitlements is not None:
        tables.append(_Checks(entitlements).unique("entitlement_unique", "user_id").child("entitlement_user", "user_id", "users").filled("entitlement_not_null", "user_id", "has_paid"))
    expanded = tables[0].rows()
    for table in tables[1:]:
        expanded = expanded.unionByName(table.rows())
    counted = expanded.groupBy("space", "key", "rule").agg(F.count("*").alias("n"))
    has_parent = F.max(F.col("rule") == _PARENT).over(Window.partitionBy("space", "key"))
    judged = counted.withColumn("__known", has_parent).filter(F.col("rule") != _PARENT)
    hits = (F.when(F.col("space").startswith("unique "), (F.col("n") > 1).cast("bigint")).when(F.col("space").startswith("bad "), F.col("n"))
            .otherwise(F.when(F.col("__known"), 0).otherwise(F.col("n"))))
    found = judged.groupBy(F.col("rule").alias("constraint")).agg(F.sum(hits).alias("violations"))
    names = [name for table in tables for name in table.names()]
    every = users.sparkSession.createDataFrame([(name,) for name in names], "constraint string")
    return every.join(found, "constraint", "left").withColumn("violations", F.coalesce("violations", F.lit(0).cast("bigint")))
