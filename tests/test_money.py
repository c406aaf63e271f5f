from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from depthspark.functions import currency as cur
from depthspark.operators import money
from tests.conftest import rows

PLANS = [("weekly", "FIXED", 7, True), ("monthly", "FIXED", 30, True), ("yearly", "FIXED", 365, False), ("pay_as_you_go", "PER_DAY", None, True)]
PRICES = [("weekly", "UZS", D(50000), True), ("monthly", "UZS", D(150000), True), ("monthly", "USD", D(15), False),
          ("yearly", "UZS", D(1500000), True), ("pay_as_you_go", "UZS", D(8000), True)]


def plans(spark):
    return spark.createDataFrame(PLANS, "code string, type string, duration_days int, active boolean")


def prices(spark, extra=()):
    return spark.createDataFrame([*PRICES, *extra], "code string, currency string, amount decimal(38,18), active boolean")


def test_catalogue_leaves_out_inactive_and_unpriced(spark):
    listed = money.plan_catalog(plans(spark), prices(spark), "uzs").orderBy("code")
    assert [(r["code"], r["amount_text"]) for r in listed.collect()] == [
        ("monthly", "150000.00"), ("pay_as_you_go", "8000.00"), ("weekly", "50000.00")]
    assert money.plan_catalog(plans(spark), prices(spark), "USD").count() == 0


def test_currency_checks(spark):
    cases = [(None, D(1), "CURRENCY_REQUIRED"), ("  ", D(1), "CURRENCY_REQUIRED"), ("US", D(1), "BAD_CODE"), ("U5D", D(1), "BAD_CODE"),
             ("EUR", D(1), "UNSUPPORTED_CURRENCY"), (" usd ", D("19.900"), None), ("USD", D("19.999"), "TOO_MANY_DECIMALS"),
             ("UZS", D("480.888"), "TOO_MANY_DECIMALS"), ("BTC", D("0.00000001"), None), ("BTC", D("0.000000001"), "TOO_MANY_DECIMALS"),
             ("ETH", D("0.000000000000000001"), None), ("UZS", None, None)]
    df = spark.createDataFrame([(i, c, a) for i, (c, a, _) in enumerate(cases)], "i int, currency string, amount decimal(38,18)")
    got = dict(rows(money.check_money(df), "i", "error"))
    assert got == {i: e for i, (_, _, e) in enumerate(cases)}


def test_display_never_rounds(spark):
    df = spark.createDataFrame([("UZS", D("150000")), ("BTC", D("0.5")), ("ETH", D("1")), ("UZS", D("1.005"))], "currency string, amount decimal(38,18)")
    assert [r["amount_text"] for r in money.display_amount(df).collect()] == ["150000.00", "0.50000000", "1.000000000000000000", None]


def test_minor_units_are_exact(spark):
    df = spark.createDataFrame([(D("200"),), (D("1.23"),), (D("1.234"),), (D("0.000000000000000001"),)], "amount decimal(38,18)")
    assert [r["minor"] for r in money.to_minor(df).collect()] == [20000, 123, None, None]


def test_days_round_up_exactly(spark):
    # ETH may carry all 18 places, so a price in it shows that no digit is lost on the way up.
    extra = [("pay_as_you_go", "ETH", D(8000), True), ("pay_as_you_go", "USD", D(0), True)]
    cases = [("UZS", D(8000), 1, None), ("UZS", D("8000.01"), 2, None), ("UZS", D(1), 1, None), ("ETH", D("8000.000000000000000001"), 2, None),
             ("uzs", D(80000), 10, None), ("UZS", D(0), None, "AMOUNT_NOT_POSITIVE"), ("UZS", D("1.001"), None, "TOO_MANY_DECIMALS"),
             ("UZS", None, None, "AMOUNT_NOT_POSITIVE"), ("BTC", D(1), None, "NO_PRICE"), ("USD", D(1), None, "PRICE_NOT_SET"), ("X", D(1), None, "BAD_CODE")]
    df = spark.createDataFrame([(i, c, a) for i, (c, a, _, _) in enumerate(cases)], "i int, currency string, amount decimal(38,18)")
    out = money.quote_days(df, plans(spark), prices(spark, extra))
    assert rows(out, "i", "days", "error") == [(i, d, e) for i, (_, _, d, e) in enumerate(cases)]


def test_admin_view_shows_everything(spark):
    view = {r["code"]: len(r["prices"]) for r in money.plan_admin_view(plans(spark), prices(spark).filter("code <> 'weekly'")).orderBy("code").collect()}
    assert view == {"monthly": 2, "pay_as_you_go": 1, "weekly": 0, "yearly": 1}


def test_major_units(spark):
    assert spark.range(1).select(cur.major_units(F.lit(12345))).first()[0] == D("123.45")
