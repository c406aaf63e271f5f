"""Schemas of the stored tables and of raw messages, as DDL text that every reader takes."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "users": "id string, email string, role string, enabled boolean, email_verified boolean, "
             "created_at timestamp, last_seen_at timestamp",
    "classification_rules": "user_id string, symbol string, market string, tier_no int, min_notional double, "
                            "max_distance double",
    "plans": "id string, code string, display_name string, type string, duration_days int, active boolean",
    "plan_prices": "plan_id string, currency string, amount decimal(38,18), active boolean",
    "user_entitlement": "user_id string, access_expires_at timestamp, has_paid boolean",
    "orders": "id string, user_id string, plan_id string, status string, granted_duration_seconds bigint, "
              "amount decimal(38,18), currency string, provider_uuid string, receipt_url string, "
              "expires_at timestamp, paid_at timestamp, created_at timestamp",
    "order_status_history": "order_id string, from_status string, to_status string, reason string, "
                            "reason_detail string, source string, created_at timestamp, seq bigint",
    "entitlement_ledger": "user_id string, source string, granted_duration_seconds bigint, "
                          "previous_expires_at timestamp, new_expires_at timestamp, order_id string, "
                          "admin_id string, reason string, created_at timestamp",
    "connection_events": "id bigint, user_id string, connected_at timestamp, day date",
}

RAW_DEPTH = "kind string, symbol string, market string, raw string, recv_ms bigint"
