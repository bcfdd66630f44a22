"""Facet checks on raw strings: each returns true when the value is allowed.

A null value passes, because presence is a rule of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faktorium import codes
from faktorium.functions.text import collapse_whitespace


def _passes(value: Column, condition: Column) -> Column:
    return value.isNull() | F.coalesce(condition, F.lit(False))


# The patterns of amounts, prices and quantities allow as many digits as the types do: 16 and 2, 14 and 8, 16 and 6.
def check_amount(value: Column) -> Column:
    return _passes(value, value.rlike(codes.PATTERN_AMOUNT))


def check_unit_price(value: Column) -> Column:
    return _passes(value, value.rlike(codes.PATTERN_UNIT_PRICE))


def check_quantity(value: Column) -> Column:
    return _passes(value, value.rlike(codes.PATTERN_QUANTITY))


def check_percent(value: Column) -> Column:
    """A decimal number from 0 to 100 with at most six decimals; surrounding white space collapses.

    The type has no pattern: any decimal literal counts, with a sign, leading or trailing zeros, or one side of the
    point empty.
    """
    bare = collapse_whitespace(value)
    whole = F.regexp_extract(bare, r"^[+-]?0*([0-9]*)", 1)
    decimals = F.regexp_extract(bare, r"\.([0-9]*?)0*$", 1)
    number = F.concat(F.lit("0"), whole, F.lit("."), decimals, F.lit("0"))
    small = (F.length(whole) <= 3) & (F.length(decimals) <= 6)
    amount = F.when(small, number).try_cast("decimal(10,7)")
    in_range = F.when(bare.startswith("-"), amount == 0).otherwise(amount <= 100)
    return _passes(value, bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$") & F.coalesce(in_range, F.lit(False)))


def check_text_length(value: Column, longest: int, shortest: int = 1) -> Column:
    """Length after white space collapses, which is not done for a text that is short enough and starts with something else."""
    fits = F.length(collapse_whitespace(value)).between(shortest, longest)
    if shortest == 1:
        fits = ((F.length(value) <= longest) & ~F.substring(value, 1, 1).isin("", " ", "\t", "\r", "\n")) | fits
    return _passes(value, fits)


def check_date_range(value: Column, kind: str = "TData") -> Column:
    low, high = codes.DATE_RANGES[kind]
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value).try_cast("date")
    return _passes(value, day.between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def _moment(value: Column) -> Column:
    pattern = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
    return F.when(value.rlike(pattern), value).try_cast("timestamp")


def check_time_range(value: Column, low: str = codes.TIME_RANGE[0], high: str = codes.TIME_RANGE[1]) -> Column:
    return _passes(value, _moment(value).between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))


def check_header_time(value: Column, variant: int) -> Column:
    """Creation time of the document; the lower bound depends on the schema variant."""
    return check_time_range(value, codes.HEADER_TIME_FROM[variant], codes.HEADER_TIME_TO)


def check_digit_count(value: Column, *counts: int) -> Column:
    """Digits only, as many as one of the counts."""
    return _passes(value, value.rlike("^(" + "|".join(rf"[0-9]{{{n}}}" for n in counts) + ")$"))


def check_positive(value: Column) -> Column:
    return _passes(value, value.rlike(r"^\d+$") & (value.try_cast("decimal(38,0)") > 0))


def check_listed(value: Column, name: str) -> Column:
    return _passes(value, value.isin(codes.CODE_LISTS[name]))


def check_flag(value: Column, two_valued: bool = True) -> Column:
    return _passes(value, value.isin(["1", "2"] if two_valued else ["1"]))


def check_bank_account(value: Column, variant: int = 2) -> Column:
    if variant == 2:
        return _passes(value, value.rlike(codes.PATTERN_ACCOUNT))
    return _passes(value, F.length(value).between(10, 34))


def check_swift(value: Column) -> Column:
    return _passes(value, value.rlike(codes.PATTERN_SWIFT))


def check_generic_vat(value: Column) -> Column:
    return _passes(value, value.rlike(codes.PATTERN_VAT_EU))


def check_payment_id(value: Column) -> Column:
    return _passes(value, value.rlike(codes.PATTERN_PAYMENT_ID))


def check_payment_link(link: Column, payment_id: Column) -> Column:
    """The link has the declared form and carries the payment id of the invoice."""
    same = payment_id.isNull() | F.contains(link, payment_id)
    return _passes(link, link.rlike(codes.PATTERN_PAYMENT_LINK) & same & (F.length(link) <= 512))


def parse_clearance_number(value: Column) -> Column:
    """Split into taxpayer, date, blocks and check pair; ``is_valid`` needs a real date."""
    part = lambda i: F.regexp_extract(value, codes.PATTERN_CLEARANCE, i)
    day = F.try_to_timestamp(F.nullif(part(2), F.lit("")), F.lit("yyyyMMdd")).cast("date")
    return F.struct(
        F.nullif(part(1), F.lit("")).alias("taxpayer"),
        day.alias("received_on"),
        F.nullif(F.concat(part(3), part(4)), F.lit("")).alias("technical"),
        F.nullif(part(5), F.lit("")).alias("check_pair"),
        day.isNotNull().alias("is_valid"),
    )


def _present(*branches: Column) -> Column:
    return sum((F.when(b.isNotNull(), 1).otherwise(0) for b in branches), F.lit(0))


def exactly_one(*branches: Column) -> Column:
    return _present(*branches) == 1


def at_most_one(*branches: Column) -> Column:
    return _present(*branches) <= 1


def all_or_none(*members: Column) -> Column:
    return _present(*members).isin(0, len(members))
