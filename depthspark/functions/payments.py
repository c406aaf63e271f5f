"""Order states, provider states and signatures as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order states and the moves between them that are allowed.
STATUSES = ("CREATED", "PENDING", "PAID", "EXPIRED", "FAILED", "CANCELED", "REVERTED")
OPEN = ("CREATED", "PENDING")
MOVES = {
    "CREATED": ("PENDING", "CANCELED", "EXPIRED"),
    "PENDING": ("PAID", "EXPIRED", "FAILED", "CANCELED", "REVERTED"),
    "PAID": ("REVERTED",),
    "EXPIRED": ("PAID",),
    "FAILED": ("PAID",),
    "CANCELED": ("PAID",),
}

# Provider words for a payment's state; every other word means PENDING.
PROVIDER_WORDS = {
    "success": "SUCCESS", "error": "ERROR", "revert": "REVERT", "cancelled": "CANCELED", "canceled": "CANCELED",
    "draft": "PENDING", "progress": "PENDING", "billing": "PENDING",
}
NOT_FOUND_CODE = "ERROR_NOT_FOUND"


def is_open(status: Column) -> Column:
    return status.isin(*OPEN)


def allowed(before: Column, after: Column) -> Column:
    """Whether a move is legal; the first state of an order always is."""
    legal = before.isNull()
    for source, targets in MOVES.items():
        legal = legal | ((before == source) & after.isin(*targets))
    return F.coalesce(legal, F.lit(False))


def provider_status(word: Column, error_code: Column) -> Column:
    """Null where the fetch failed for a reason other than an unknown payment."""
    known = F.lit("PENDING")
    for text, status in PROVIDER_WORDS.items():
        known = F.when(word == text, status).otherwise(known)
    return F.when(error_code == NOT_FOUND_CODE, "NOT_FOUND").when(error_code.isNull(), known)


def signature(store_id: Column, invoice_id: Column, amount: Column, secret: Column) -> Column:
    """MD5 over the four fields; a missing field is written as ``null``."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in (store_id, invoice_id, amount)]
    return F.md5(F.concat(*parts, secret))
