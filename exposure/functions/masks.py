"""Format-preserving masks.  Only masked text may reach a stored table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOT = "•"


def keep_last(value: Column, reveal: int = 4) -> Column:
    """Letters and digits become X except the last few, never showing over half."""
    tagged = F.transform(
        F.split(value, ""),
        lambda c: F.struct(c.alias("c"), c.rlike(r"^[\p{L}\p{N}]$").alias("a")),
    )
    alnum = F.length(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    hidden = alnum - F.least(F.lit(reveal), F.floor(alnum / 2).cast("int"))

    def step(acc: Column, x: Column) -> Column:
        mark = F.when(x["a"] & (acc["n"] < hidden), F.lit("X")).otherwise(x["c"])
        return F.struct(
            (acc["n"] + x["a"].cast("int")).alias("n"), F.concat(acc["t"], mark).alias("t")
        )

    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"))
    return F.aggregate(tagged, zero, step, lambda acc: acc["t"])


def address(value: Column) -> Column:
    """``p•••@host``: first letter and the part after the first @ stay."""
    local = F.substring_index(value, "@", 1)
    host = F.substr(value, F.length(local) + 2, F.length(value))
    hidden = F.repeat(F.lit(DOT), F.length(local) - 1)
    return F.when(
        F.length(local) <= 1, F.concat(F.repeat(F.lit(DOT), F.length(local)), F.lit("@"), host)
    ).otherwise(F.concat(F.substring(local, 1, 1), hidden, F.lit("@"), host))


def secret(value: Column) -> Column:
    """First four characters and twelve dots; short secrets are all dots."""
    return F.when(F.length(value) <= 8, F.repeat(F.lit(DOT), F.length(value))).otherwise(
        F.concat(F.substring(value, 1, 4), F.lit(DOT * 12))
    )


def generic(value: Column) -> Column:
    return F.repeat(F.lit(DOT), F.least(F.length(value), F.lit(12)))


def mask_for(pii_type: Column, value: Column) -> Column:
    return (
        F.when(pii_type.isin("email", "upi_id"), address(value))
        .when(pii_type.isin("api_key", "jwt", "password"), secret(value))
        .when(value.rlike(r"^\p{L}+$"), generic(value))
        .otherwise(keep_last(value))
    )
