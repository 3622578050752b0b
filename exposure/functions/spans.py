"""All matches of a pattern, with their places in the text.

Spark has no "find all with offsets".  Matches and the gaps between them are both
available (``regexp_extract_all`` and ``split``), and the running sum of their
lengths gives the offsets, in characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,v:string>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


#: matches per block of the two-level running sum
BLOCK = 128


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)


def _running(numbers: Column, fold, join, body) -> Column:
    """``body(before)`` where ``before(i)`` folds the first ``i`` numbers.

    Blocks of 128 are folded first, so the work is linear for any real text and no array
    is rebuilt per match.
    """

    def folded(w: Column) -> Column:
        last = F.floor((F.size(w) - 1) / BLOCK).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda k: fold(F.slice(w, k * BLOCK + 1, F.lit(BLOCK))),
        )
        return bind(blocks, lambda whole: bind(
            F.transform(whole, lambda _, k: fold(F.slice(whole, F.lit(1), k))),
            lambda reached: body(
                lambda i: join(
                    F.get(reached, F.floor(i / BLOCK).cast("int")),
                    fold(F.slice(w, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
                )
            ),
        ))

    return bind(numbers, folded)


def running_starts(widths: Column, body) -> Column:
    """``body(before)`` where ``before(i)`` is the sum of the first ``i`` of ``widths``."""
    return _running(widths, _total, lambda a, b: a + b, body)


def running_reach(ends: Column, body) -> Column:
    """``body(before)`` where ``before(i)`` is the largest of the first ``i`` of ``ends``, -1 for none."""
    largest = lambda a: F.coalesce(F.array_max(a), F.lit(-1))
    return _running(ends, largest, F.greatest, body)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<s,e,v>>`` of every match, 0-based half-open character offsets.

    With ``group=1`` the span is that of the group, which must end the match.
    """
    def placed(found: Column) -> Column:
        return bind(F.split(text, pattern, -1), lambda gaps: _placed(found, gaps, pattern, group))

    # a text without a match is not searched a second time for its gaps
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(matches, lambda found: F.when(F.size(found) == 0, no_spans()).otherwise(placed(found).cast(SPANS)))


def _placed(found: Column, gaps: Column, pattern: str, group: int) -> Column:
    widths = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g))

    def span(before, m: Column, i: Column) -> Column:
        stop = before(i) + F.length(F.get(gaps, i)) + F.length(m)
        value = m if group == 0 else F.regexp_extract(m, pattern, group)
        return F.struct((stop - F.length(value)).alias("s"), stop.alias("e"), value.alias("v"))

    return running_starts(widths, lambda before: F.transform(found, lambda m, i: span(before, m, i)))


def guarded_spans(text: Column, guard: Column, pattern: str, group: int = 0) -> Column:
    """Spans where the cheap ``guard`` holds, else an empty array."""
    return F.when(guard, spans(text, pattern, group)).otherwise(no_spans())


def near_spans(text: Column, left: str, right: str, window: int) -> Column:
    """Spans of ``left`` having a whole ``right`` match at most ``window`` characters away.

    The window keeps the character before it, so a word boundary at its left edge is
    judged on the real text; past its right edge nothing is seen.  A word cut by that
    edge ends there, so a test of ``right`` on the whole text would not be a safe guard.
    """
    inner = f"(?s)^.(?:.*?)(?:{right})"

    def close(span: Column) -> Column:
        before = span["s"] - window
        size = span["e"] - span["s"] + window
        at_start = F.substr(text, F.lit(1), span["e"] + window).rlike(right)
        inside = F.substr(text, before, size + window + 1).rlike(inner)
        return F.when(before <= 0, at_start).otherwise(inside)

    return F.when(text.rlike(left), F.filter(spans(text, left), close)).otherwise(no_spans())


def resolve_overlaps(candidates: Column) -> Column:
    """Greedy choice of disjoint spans, best first, returned in text order.

    ``candidates`` are structs with ``s`` and ``e``; their other leading fields rank them.  Candidates are split into runs of touching spans, so the pairwise test
    stays inside one run however long the text is.
    """
    by_start = F.transform(
        F.array_sort(F.transform(candidates, lambda c: F.struct(c["s"].alias("at"), c.alias("c")))), lambda x: x["c"]
    )

    def choose(run: Column) -> Column:
        def take(kept: Column, c: Column) -> Column:
            clash = F.exists(kept, lambda k: (c["s"] < k["e"]) & (k["s"] < c["e"]))
            return F.when(clash, kept).otherwise(F.concat(kept, F.array(c)))

        kept = F.aggregate(F.array_sort(run), F.slice(run, 1, 0), take)
        in_order = F.array_sort(
            F.transform(kept, lambda c: F.struct(c["s"].alias("at"), c.alias("c")))
        )
        picked = F.transform(in_order, lambda x: x["c"])
        return F.when(F.size(run) <= 1, run).otherwise(picked)

    def resolved(spans_: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(spans_) - 1)
        heads = running_reach(
            F.transform(spans_, lambda c: c["e"]),
            lambda before: F.filter(every, lambda i: F.get(spans_, i)["s"] >= before(i)),
        )
        return bind(heads, lambda h: F.flatten(F.transform(h, lambda at, k: choose(
            F.slice(spans_, at + 1, F.coalesce(F.get(h, k + 1), F.size(spans_)) - at)
        ))))

    return F.when(F.size(candidates) <= 1, candidates).otherwise(bind(by_start, resolved))


def first_span(text: Column, pattern: str) -> Column:
    """The first match as ``struct<s,e,v>``, NULL if there is none."""
    start = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    value = F.regexp_extract(text, pattern, 0)
    span = F.struct(start.alias("s"), (start + F.length(value)).alias("e"), value.alias("v"))
    return F.when(text.rlike(pattern), span).cast(SPAN)


def first_near(text: Column, left: str, right: str, window: int) -> Column:
    return F.get(near_spans(text, left, right, window), F.lit(0))
