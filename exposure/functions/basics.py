"""Small column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sql(value) -> str:
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_sql(v) for v in value)})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def lit_array(values, kind: str = "string") -> Column:
    return F.expr(f"cast({_sql(list(values))} AS array<{kind}>)")


def lit_map(mapping: dict) -> Column:
    """A literal lookup map; values are strings, numbers or lists of strings."""
    return F.expr(f"map({', '.join(f'{_sql(k)}, {_sql(v)}' for k, v in mapping.items())})")


def pick(mapping: dict, key: Column, default=None) -> Column:
    """``CASE key WHEN ...``; unknown keys give ``default`` (NULL if omitted)."""
    branches = None
    for k, v in mapping.items():
        v = v if isinstance(v, Column) else F.lit(v)
        branches = F.when(key == k, v) if branches is None else branches.when(key == k, v)
    return branches if default is None else branches.otherwise(default)


def half_up(x: Column) -> Column:
    """Round a non-negative number, .5 going up."""
    return F.floor(x + F.lit(0.5)).cast("int")


def half_even(x: Column) -> Column:
    """Round to an integer, ties to the even neighbour."""
    return F.rint(x).cast("int")


def round2(x: Column) -> Column:
    return F.round(x, 2)


def compact(*items: Column) -> Column:
    """Array of the non-NULL items, order kept."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def py_strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"^(?U:\s)+|(?U:\s)+$", "")


def excerpt(text: Column, limit: int = 120) -> Column:
    """White space collapsed to blanks, cut to ``limit`` characters with an ellipsis."""
    flat = py_strip(F.regexp_replace(text, r"(?U)\s+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def slice0(text: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` with 0-based offsets; ``start`` must be >= 0."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def hits_type(extra: str = "") -> str:
    return f"array<struct<name:string,penalty:int,detail:string,evidence:string{extra}>>"


def combine(hits: Column, bump: int) -> Column:
    """Worst penalty plus ``bump`` for each further hit, at most 100; 0 if none."""
    worst = F.array_max(F.transform(hits, lambda h: h["penalty"]))
    return F.when(F.size(hits) == 0, F.lit(0)).otherwise(
        F.least(F.lit(100), worst + F.lit(bump) * (F.size(hits) - 1))
    ).cast("int")


def explode_once(df: DataFrame, keep: list[str], array: str, alias: str) -> DataFrame:
    """Explode an expensive array.

    A plain explode makes the optimizer add ``size(array) > 0`` and push it below,
    which computes the array again; the outer form with a NULL filter does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(alias)).filter(F.col(alias).isNotNull())


def settle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Compute these columns once, here.

    The optimizer copies the definition of a column into every filter above it, which
    multiplies costly nested expressions (and the size of the plan).  A one-element
    explode is a border it does not cross; it stays inside code generation.
    """
    others = [c for c in df.columns if c not in columns]
    packed = F.explode_outer(F.array(F.struct(*columns))).alias("_settled")
    return df.select(*others, packed).select(*others, "_settled.*")
