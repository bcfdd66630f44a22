"""Polish amounts in words and plural forms, as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from faktorium import codes


def _below_thousand(n: int) -> str:
    hundred, ten, one = n // 100, n // 10 % 10, n % 10
    tail = [codes.TEENS[one]] if ten == 1 else [codes.TENS[ten], codes.ONES[one]]
    return " ".join(w for w in [codes.HUNDREDS[hundred], *tail] if w)


# Built from the rule once; inside a plan it is one folded constant.
GROUP_WORDS = "|".join(_below_thousand(n) for n in range(1000))


def _filled(*parts: Column) -> Column:
    """Join the non-empty parts with single blanks."""
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def plural_form(n: Column, forms: Sequence[str]) -> Column:
    """One; few for a last digit 2-4 outside the teens; many otherwise."""
    one, few, many = forms
    last, last_two = n % 10, n % 100
    return (
        F.when(n == 1, one)
        .when(last.between(2, 4) & ~last_two.between(10, 19), few)
        .otherwise(many)
    )


def group_words(n: Column) -> Column:
    """Words of a number below one thousand; empty for zero."""
    return F.element_at(F.split(F.lit(GROUP_WORDS), r"\|"), (n + 1).cast("int"))


def amount_in_words_pl(grosze: Column) -> Column:
    """Amount in words; from one million on the zloty part is written in digits."""
    total = grosze.cast("long")
    zloty = F.floor(total / 100)
    rest = total % 100
    thousands, units = F.floor(zloty / 1000), zloty % 1000
    thousand_words = F.when(thousands == 1, codes.THOUSAND_FORMS[0]).otherwise(
        F.concat_ws(" ", group_words(thousands), plural_form(thousands, codes.THOUSAND_FORMS))
    )
    zloty_words = (
        F.when(zloty == 0, "zero")
        .when(zloty < 1000, group_words(zloty))
        .when(zloty < 1_000_000, _filled(thousand_words, group_words(units)))
        .otherwise(zloty.cast("string"))
    )
    words = F.concat_ws(" ", zloty_words, plural_form(zloty, codes.ZLOTY_FORMS))
    grosz_words = F.concat_ws(" ", group_words(rest), plural_form(rest, codes.GROSZ_FORMS))
    return (
        F.when(total == 0, "zero złotych zero groszy")
        .when(rest > 0, F.concat_ws(" ", words, grosz_words))
        .otherwise(words)
    )
