"""Money in whole grosze: exact integer arithmetic, rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(numerator: Column, denominator: Column) -> Column:
    return F.call_function("div", numerator, denominator)


def to_grosze(amount: Column) -> Column:
    """Amount in currency units (double, decimal or numeric string) to grosze."""
    return F.round(amount * F.lit(100)).cast("long")


def from_grosze(grosze: Column) -> Column:
    """Grosze to ``decimal(18,2)``; division would widen the type."""
    return (grosze.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)")


def divide_half_up(numerator: Column, denominator: Column) -> Column:
    """Integer division rounded half away from zero; the denominator is positive."""
    size = _div(F.abs(numerator) * 2 + denominator, denominator * 2)
    return F.when(numerator < 0, -size).otherwise(size)


def tax_grosze(net: Column, rate: Column) -> Column:
    """VAT on a net amount for a rate in percent."""
    return divide_half_up(net * rate, F.lit(100).cast("long"))


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round half up on decimals, never on binary floats."""
    return F.round(value.cast("decimal(38,10)"), digits)


def multiply_quantity(unit_grosze: Column, quantity: Column) -> Column:
    """Unit price in grosze times a fractional quantity, rounded to whole grosze."""
    return F.round(unit_grosze.cast("decimal(18,0)") * quantity.cast("decimal(18,6)"), 0).cast("long")
