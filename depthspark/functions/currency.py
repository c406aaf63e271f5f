"""Currencies and exact decimal money. Amounts are major units as ``decimal(38,18)``."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimals each currency may carry.
DECIMALS = {"UZS": 2, "USD": 2, "BTC": 8, "ETH": 18}

MONEY = "decimal(38,18)"


def normal_code(code: Column) -> Column:
    return F.upper(F.trim(code))


def code_error(code: Column) -> Column:
    name = normal_code(code)
    return (F.when(code.isNull() | (F.trim(code) == ""), "CURRENCY_REQUIRED")
            .when(~name.rlike(r"^\p{L}{3}$"), "BAD_CODE")
            .when(~name.isin(*DECIMALS), "UNSUPPORTED_CURRENCY"))


def _unit(decimals: int) -> Column:
    return F.lit(Decimal(1).scaleb(-decimals)).cast(MONEY)


def _whole_units(amount: Column, decimals: int) -> Column:
    # The remainder of two decimals of one type is exact; a quotient would be rounded.
    return amount % _unit(decimals) == 0


def _by_currency(code: Column, make) -> Column:
    chain = None
    for name, decimals in DECIMALS.items():
        chain = (F if chain is None else chain).when(normal_code(code) == name, make(decimals))
    return chain


def scale_ok(amount: Column, code: Column) -> Column:
    """True if the amount has no more decimals than its currency; trailing zeros do not count."""
    return _by_currency(code, lambda d: _whole_units(amount, d))


def display_text(amount: Column, code: Column) -> Column:
    """Exactly the decimals of the currency, never rounded: null where a digit would be lost."""
    return _by_currency(code, lambda d: F.when(
        _whole_units(amount, d), amount.cast(f"decimal(38,{d})").cast("string")))


def minor_units(amount: Column) -> Column:
    """Hundredths as a whole number whatever the currency; null where that is not exact."""
    return F.when(_whole_units(amount, 2), F.call_function("div", amount, _unit(2)))


def major_units(minor: Column) -> Column:
    return (minor.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def ceil_ratio(amount: Column, price: Column) -> Column:
    """``ceil(amount / price)`` without a decimal quotient, which would drop digits."""
    return F.call_function("div", amount, price) + F.when(amount % price > 0, 1).otherwise(0)
