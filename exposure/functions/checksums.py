"""Check-digit tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure import dims


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _from_right(digits: Column) -> Column:
    return F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.struct(c.try_cast("int").alias("n"), i.alias("i")),
    )


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = digits_of(value)

    def weighed(x: Column) -> Column:
        doubled = x["n"] * 2
        odd = F.when(doubled > 9, doubled - 9).otherwise(doubled)
        return F.when(x["i"] % 2 == 1, odd).otherwise(x["n"])

    total = F.aggregate(
        _from_right(digits), F.lit(0), lambda acc, x: acc + F.coalesce(weighed(x), F.lit(0))
    )
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def verhoeff_ok(value: Column) -> Column:
    """Twelve digits, the first not 0 or 1, whose Verhoeff checksum is zero."""
    digits = digits_of(value)
    product, permuted = F.lit(dims.VERHOEFF_D), F.lit(dims.VERHOEFF_P)

    def at(table: Column, index: Column) -> Column:
        return F.substr(table, index + 1, F.lit(1)).try_cast("int")

    check = F.aggregate(
        _from_right(digits),
        F.lit(0),
        lambda acc, x: F.coalesce(
            at(product, acc * 10 + at(permuted, (x["i"] % 8) * 10 + x["n"])), F.lit(0)
        ),
    )
    return digits.rlike("^[2-9][0-9]{11}$") & (check == 0)


def card_brand(value: Column) -> Column:
    """Issuer by leading digits, NULL if unknown.  Discover's 65 is tested before RuPay."""
    digits = digits_of(value)
    return (
        F.when(digits.rlike("^4"), "Visa")
        .when(digits.rlike("^5[1-5]"), "Mastercard")
        .when(digits.rlike("^3[47]"), "American Express")
        .when(digits.rlike("^(?:6011|65)"), "Discover")
        .when(digits.rlike("^(?:60|81|82)"), "RuPay")
    )


def ifsc_ok(value: Column) -> Column:
    return F.upper(F.trim(value)).rlike("^[A-Z]{4}0[A-Z0-9]{6}$")
