"""Tax, personal and account identifiers: checks, control digits, composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faktorium import codes


def normalise_tax_id(value: Column) -> Column:
    """Drop dashes and white space."""
    return F.regexp_replace(value, r"[-\s]", "")


def check_nip(value: Column) -> Column:
    return F.coalesce(value.rlike(codes.PATTERN_NIP), F.lit(False))


def check_internal_id(value: Column) -> Column:
    return F.coalesce(value.rlike(codes.PATTERN_INTERNAL_ID), F.lit(False))


def _digit(value: Column, position: int) -> Column:
    """Digit at a position; the caller makes sure that there is one."""
    return F.ascii(F.substring(value, position, 1)) - 48


def _block_sums(weights: list[int], digits: int) -> Column:
    """Constant array: the weighted digit sum of every number of so many digits, leading zeros included."""
    sums = [0]
    for i in range(digits):
        sums = [s + weights[i % len(weights)] * d for s in sums for d in range(10)]
    return F.expr(f"cast(split('{','.join(map(str, sums))}', ',') as array<int>)")


def _weighted(value: Column, weights: list[int], digits: int) -> Column:
    """Control digit of a weighted digit sum, null unless the text starts with that many digits.

    The digits are taken in blocks as long as the weights, four at most: each
    block is a number that looks its sum up in a constant array.
    """
    size = min(4, len(weights))
    total = F.lit(0)
    for start in range(0, digits, size):
        length = min(size, digits - start)
        block = F.substring(value, start + 1, length).cast("int")
        total = total + F.get(_block_sums([weights[(start + i) % len(weights)] for i in range(length)], length), block)
    return F.when(value.rlike(f"^[0-9]{{{digits}}}"), (10 - total % 10) % 10).cast("int")


def pesel_control(value: Column) -> Column:
    """Control digit over the first ten digits."""
    return _weighted(value, codes.PESEL_WEIGHTS, 10)


def pesel_birth_date(value: Column) -> Column:
    """The month carries the century (1900-2299); null when it is no calendar day."""
    month = F.substring(value, 3, 2).try_cast("int")
    century = F.lit(19) + F.floor(month / 20)
    text = F.concat(
        century.cast("string"), F.substring(value, 1, 2), F.lit("-"),
        F.lpad((month % 20).cast("string"), 2, "0"), F.lit("-"), F.substring(value, 5, 2),
    )
    return F.when(value.rlike(codes.PATTERN_PESEL), text.try_cast("date"))


def check_pesel(value: Column) -> Column:
    """Pattern, real calendar day and control digit."""
    good = (
        value.rlike(codes.PATTERN_PESEL)
        & pesel_birth_date(value).isNotNull()
        & (_digit(value, 11) == pesel_control(value))
    )
    return F.coalesce(good, F.lit(False))


def account_check_digits(account: Column) -> Column:
    """Check pair of a domestic account of 24 digits: a weighted control digit, zero-padded."""
    return F.lpad(_weighted(account, codes.ACCOUNT_WEIGHTS, 24).cast("string"), 2, "0")


def _mod97(digits: Column) -> Column:
    """Remainder of up to 38 digits, in two exact steps of decimal arithmetic."""
    return (digits.try_cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)")).cast("int")


def iban_check_digits(account: Column) -> Column:
    """98 minus the remainder of account + country code + 00."""
    return F.lpad((98 - _mod97(F.concat(account, F.lit("252100")))).cast("string"), 2, "0")


def check_iban_pl(value: Column, profile: str = "standard") -> Column:
    """``standard``: PL, check pair and the 24 digits of bank and account.

    ``reference``: the check pair is followed by 26 digits, which start with the
    weighted check pair of the other 24.
    """
    pair, account = F.substring(value, 3, 2), F.substring(value, 5, 26)
    if profile == "standard":
        good = value.rlike(r"^PL\d{26}$") & (pair == iban_check_digits(account))
    elif profile == "reference":
        inner = F.substring(account, 1, 2) == account_check_digits(F.substring(account, 3, 24))
        good = value.rlike(r"^PL\d{28}$") & (pair == iban_check_digits(account)) & inner
    else:
        raise ValueError(f"unknown profile {profile}")
    return F.coalesce(good, F.lit(False))


def compose_nip_vat_eu(nip: Column, vat: Column) -> Column:
    return F.concat_ws("-", nip, vat)


def check_vat_eu(value: Column, profile: str = "standard") -> Column:
    """Country prefix and the grammar of that country.

    The ``reference`` profile also takes Lithuanian numbers without a prefix.
    """
    country, rest = F.substring(value, 1, 2), F.substring(value, 3, 20)
    branches = F.lit(False)
    for code, grammar in codes.VAT_EU_GRAMMAR.items():
        branches = F.when(country == code, rest.rlike(f"^({grammar})$")).otherwise(branches)
    if profile == "reference":
        branches = branches | value.rlike(f"^({codes.VAT_EU_GRAMMAR['LT']})$")
    return F.coalesce(branches, F.lit(False))


def check_nip_vat_eu(value: Column, profile: str = "standard") -> Column:
    """``NIP-VAT`` composite."""
    return check_nip(F.substring_index(value, "-", 1)) & check_vat_eu(F.substring(value, 12, 30), profile)
