"""Plan catalogue, day quotes and money checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthspark.functions import currency as cur

DAY_PLAN = "pay_as_you_go"


def plan_catalog(plans: DataFrame, prices: DataFrame, currency: str) -> DataFrame:
    """Active plans with an active price in the currency."""
    code = currency.strip().upper()
    if code not in cur.DECIMALS:
        raise ValueError(f"unsupported currency: {currency}")
    active = prices.filter(F.col("active") & (F.col("currency") == code)).select("code", "amount")
    return (plans.filter("active").join(active, "code")
            .select(*[c for c in plans.columns if c != "active"], "amount",
                    cur.display_text(F.col("amount"), F.lit(code)).alias("amount_text")))


def check_money(requests: DataFrame) -> DataFrame:
    """Adds ``code`` (normalised) and ``error``: a bad currency, or more decimals than it may carry."""
    error = F.coalesce(
        cur.code_error(F.col("currency")),
        F.when(~cur.scale_ok(F.col("amount"), F.col("currency")), "TOO_MANY_DECIMALS"))
    return requests.withColumns({"code": cur.normal_code(F.col("currency")), "error": error})


def display_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("amount_text", cur.display_text(F.col("amount"), F.col("currency")))


def to_minor(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Adds ``minor``; null where the amount is not whole in hundredths."""
    return df.withColumn("minor", cur.minor_units(F.col(amount)))


def quote_days(requests: DataFrame, plans: DataFrame, prices: DataFrame, plan_code: str = DAY_PLAN) -> DataFrame:
    """Adds ``days`` and ``error``: how many days an amount buys under the per-day plan.

    The join is on the currency, of which an active plan has one price each.
    """
    per_day = (prices.filter(F.col("active") & (F.col("code") == plan_code))
               .join(plans.filter("active").select("code"), "code", "left_semi")
               .select(F.col("currency").alias("__currency"), F.col("amount").alias("__price")))
    amount, price = F.col("amount"), F.col("__price")
    checked = check_money(requests).withColumnRenamed("error", "__error")
    joined = checked.join(per_day, F.col("code") == F.col("__currency"), "left")
    bad_code = F.col("__error").isNotNull() & (F.col("__error") != "TOO_MANY_DECIMALS")
    error = (F.when(bad_code, F.col("__error")).when(price.isNull(), "NO_PRICE")
             .when(amount.isNull() | (amount <= 0), "AMOUNT_NOT_POSITIVE")
             .when(F.col("__error").isNotNull(), F.col("__error"))
             .when(price <= 0, "PRICE_NOT_SET"))
    return (joined.withColumn("error", error)
            .withColumn("days", F.when(F.col("error").isNull(), cur.ceil_ratio(amount, price)))
            .select(*requests.columns, "days", "error"))


def plan_admin_view(plans: DataFrame, prices: DataFrame) -> DataFrame:
    """All plans, each with all its prices, active or not."""
    listed = prices.groupBy("code").agg(
        F.sort_array(F.collect_list(F.struct("currency", "amount", "active"))).alias("prices"))
    return (plans.join(listed, "code", "left")
            .withColumn("prices", F.coalesce("prices", F.expr(
                "CAST(array() AS ARRAY<STRUCT<currency:STRING,amount:DECIMAL(38,18),active:BOOLEAN>>)"))))
