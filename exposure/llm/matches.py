"""Matches of patterns with their places and neighbourhood, in Spark expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure.functions.spans import bind, running_starts

MATCH = "array<struct<start:long,end:long,value:string,before:string,after:string>>"
NEAR = 40


def matches(text: Column, pattern: str, guard: Column | None = None, near: int = NEAR, least: int | None = None) -> Column:
    """Leftmost non-overlapping matches, offsets in code points, end exclusive.

    ``before`` and ``after`` are up to ``near`` characters on either side, as far as the
    neighbouring matches.  With ``least``, the fewest characters of a match, they are read
    across neighbouring matches.  ``guard`` is a cheap test without which no match is possible.
    """
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")
    )

    def placed(p: Column) -> Column:
        widths = F.zip_with(
            p["m"], F.slice(p["g"], F.lit(1), F.size(p["m"])), lambda m, g: F.length(m) + F.length(g)
        )

        def one(before, m: Column, i: Column) -> Column:
            start = before(i) + F.length(F.get(p["g"], i))
            return F.struct(
                start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"),
                F.right(F.get(p["g"], i), F.lit(near)).alias("before"),
                F.left(F.get(p["g"], i + 1), F.lit(near)).alias("after"),
            )

        return running_starts(widths, lambda before: F.transform(p["m"], lambda m, i: one(before, m, i)))

    def across(p: Column) -> Column:
        """The same with ``before`` and ``after`` joined from so many gaps and matches as ``near`` may span."""
        n_parts = 2 * -(-near // least) + 1
        gaps_first = F.flatten(F.zip_with(p["g"], p["m"], lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
        ends = F.struct(
            F.transform(gaps_first, lambda x: F.right(x, F.lit(near))).alias("tails"),
            F.transform(gaps_first, lambda x: F.left(x, F.lit(near))).alias("heads"),
        )

        def wide(e: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                n = F.least(2 * i + 1, F.lit(n_parts))
                return F.struct(
                    m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
                    F.right(F.array_join(F.slice(e["tails"], 2 * i + 2 - n, n), ""), F.lit(near)).alias("before"),
                    F.left(F.array_join(F.slice(e["heads"], 2 * i + 3, F.lit(n_parts)), ""), F.lit(near)).alias("after"),
                )

            return F.transform(placed(p), one)

        return bind(ends, wide)

    out = bind(found, placed if least is None else across).cast(MATCH)
    return out if guard is None else F.when(guard, out).otherwise(F.array().cast(MATCH))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column, least: int, most: int) -> Column:
    """``least`` to ``most`` digits with a Luhn sum that ends in zero."""
    d = digits(value)

    def checked(number: Column) -> Column:
        n = F.length(number)

        def weighed(i: Column) -> Column:
            digit = F.ascii(F.substr(number, n - i, F.lit(1))) - 48
            twice = digit * 2
            return F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + weighed(i))
        return F.when(n.between(least, most), total % 10 == 0).otherwise(False)

    return bind(d, checked)


def mod_97(value: Column) -> Column:
    """The check of international account numbers: letters count 10 to 35, the head goes last."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(found: Column) -> Column:
    """Spans by start, then by the order of their kinds (``rank``)."""
    return F.array_sort(found)
