"""From payment signals to access: which orders are paid, their status steps, their grants, and who has access then."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthspark.operators import access, orders


def applied_history(signals: DataFrame, known: DataFrame) -> DataFrame:
    """The status step that each granting signal appends: ``order_id, from_status, to_status, at_s, source``."""
    told = orders.grants_from_success(signals, known)[1].filter(F.col("verdict") == "GRANT")
    return told.join(known.select("order_id", F.col("status").alias("from_status")), "order_id").select(
        "order_id", "from_status", F.lit("PAID").alias("to_status"), "at_s", "source")


def access_after(signals: DataFrame, known: DataFrame, ledger: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    """``access_state`` of all users once the signals are applied.

    ``ledger`` has the grants so far: ``grant_id (string), user_id, granted_at, granted_seconds, source``; ``known`` orders have
    ``granted_seconds``.
    """
    return _state_with(orders.grants_from_success(signals, known)[0], ledger, users, as_of)


def log_grants(log: DataFrame, known: DataFrame) -> DataFrame:
    """The grants of ``orders.payment_log``: an order is granted by the event that paid it, once."""
    return log.filter("grants").join(known.select("order_id", "user_id", "granted_seconds"), "order_id").select(
        F.concat(F.lit("order-"), F.col("order_id").cast("string")).alias("grant_id"), "user_id", F.timestamp_seconds("at_s").alias("granted_at"), "granted_seconds",
        F.lit("PURCHASE").alias("source"))


def access_from_logs(callbacks: DataFrame, sweeps: DataFrame, known: DataFrame, secrets: DataFrame, allowed_ip: str, ledger: DataFrame,
                     users: DataFrame, as_of: datetime) -> DataFrame:
    """``access_state`` of all users from the logs of callbacks and sweeps, as one plan."""
    log = orders.payment_log(callbacks, sweeps, known, secrets, allowed_ip)
    return _state_with(log_grants(log, known), ledger, users, as_of)


def _state_with(new: DataFrame, ledger: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    columns = ["grant_id", "user_id", "granted_at", "granted_seconds", "source"]
    old = ledger.withColumn("granted_at", F.col("granted_at").cast("timestamp"))
    folded = access.fold_grants(old.select(*columns).unionByName(new.select(*columns)))
    return access.access_state(users, access.current_entitlement(folded), as_of)
