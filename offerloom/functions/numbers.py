"""Quantities and money. Money is exact: decimals of 28 digits, 18 of them behind the point, rounded only where it is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,18)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def times(a: Column, b: Column) -> Column:
    """A product, brought back to MONEY at once so that its scale is not cut later."""
    return (a.cast("decimal(20,9)") * b.cast("decimal(18,9)")).cast(MONEY)


def over(a: Column, b: Column) -> Column:
    """A quotient; null for zero or negative divisors."""
    return F.when(b > 0, a.cast("decimal(24,12)") / b.cast("decimal(12,6)")).cast(MONEY)


def rounded(c: Column, decimals: int = 2) -> Column:
    """Half away from zero."""
    return F.round(c, decimals)


def total_stems(quantity: Column, unit: Column, stems_per_box: Column, stems_per_bunch: Column | None = None) -> Column:
    """Stems of a quantity: boxes must be whole and have stems; bunches need their stems; kilograms can't tell."""
    bunch = F.lit(None).cast("int") if stems_per_bunch is None else stems_per_bunch
    return (
        F.when(unit == "STEMS", F.floor(quantity + F.lit(0.5)))
        .when((unit == "BOXES") & (stems_per_box > 0) & (quantity == F.floor(quantity)), F.floor(quantity * stems_per_box))
        .when((unit == "BUNCHES") & (bunch > 0), F.floor(quantity * bunch + F.lit(0.5)))
        .cast("long")
    )


def boxes_available(quantity: Column, unit: Column) -> Column:
    return F.when((unit == "BOXES") & (quantity == F.floor(quantity)), quantity.cast("int"))


def valid_fob(price: Column) -> Column:
    return F.coalesce(price.try_cast("decimal(28,12)") > 0, F.lit(False))


def display_rate(rate: Column, from_currency: Column, to_currency: Column, base: str = "EUR") -> Column:
    """How a rate of the base currency is shown: as it is from the base, inverted to 6 decimals to it, null for one currency."""
    return F.when(from_currency == to_currency, None).when(from_currency == base, rate.cast("decimal(18,6)")).when(
        rate != 0,
        F.round(F.lit(1).cast("decimal(20,12)") / rate.cast("decimal(12,6)"), 6).cast("decimal(18,6)")
    )
