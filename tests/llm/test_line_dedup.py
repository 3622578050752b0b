import random

import pytest
from pyspark.sql import functions as F

from exposure.llm import line_dedup
from exposure.llm.line_dedup import without_repeated_lines


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute(rows, min_chars):
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        kept = []
        for raw in (text or "").split("\n"):
            line = raw.strip(" \t\x0b\x0c\r")
            if len(line) >= min_chars:
                if any(within_one(line, s) for s in seen):
                    seen.append(line)
                    continue
                seen.append(line)
            kept.append(raw)
        out[doc] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("seed,min_chars", [(1, 4), (2, 20)])
def test_against_brute_force(spark, seed, min_chars):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("ab é") for _ in range(rng.randrange(3, 40))) for _ in range(25)]

    def line():
        s = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(s) + 1)
            s[p:p + rng.randrange(2)] = rng.choice(["", "a", "b", "x", "ñ"])
        return rng.choice(["", " ", "\t"]) + "".join(s) + rng.choice(["", " ", "\r"])

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 6)))) for i in range(70)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 5000 + "\n" + "x" * 5001 + "\n" + "x" * 4000), (None, rows[3][1])]
    df = spark.createDataFrame([(i, t, 7, 8, "q") for i, t in rows], "doc_id long, text string, n_lines int, line int, h string")
    out = without_repeated_lines(df.repartition(4), min_chars=min_chars).collect()
    want = brute(rows, min_chars)
    assert {r.doc_id: r.text for r in out} == want
    assert {(r.line, r.h) for r in out} == {(8, "q")} and sum(r.n_dropped for r in out) > 20


def test_repeated_rows_and_no_rows(spark):
    text = "this is a line of some length\nand another one of some length"
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in without_repeated_lines(df).collect())
    assert got == [(1, text, 2, 0), (1, text, 2, 0), (2, "", 2, 2)]
    assert without_repeated_lines(df.filter(F.lit(False))).count() == 0


def test_variants_are_never_broadcast(spark):
    """A variant per character of a line: Spark sizes them as the lines and would send them all through the driver."""
    lines = spark.sql("SELECT id AS row, id AS doc, 0 AS line, concat('a line of some length ', id % 7) AS text FROM range(9)")
    lines = lines.withColumn("h", F.xxhash64("text"))
    place = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "row", "line")
    keys = F.array(*[line_dedup._piece_key(F.col("text"), 2, F.lit(k)) for k in range(4)])
    first = lines.withColumn("keys", keys).groupBy("h").agg(F.min(place).alias("first"), F.first("keys").alias("keys"))
    plan = line_dedup._neighbours(lines, first)._jdf.queryExecution().executedPlan().toString()
    above, movers = [], []
    for row in plan.splitlines():
        depth = len(row) - len(row.lstrip(" :+-*()0123456789"))
        above = [(d, name) for d, name in above if d < depth]
        if "MapInArrow" in row:
            movers.append([name for _, name in above][-1:])
        if "Exchange" in row:
            above.append((depth, "broadcast" if "BroadcastExchange" in row else "shuffle"))
    # what a shuffle has moved is measured before it is broadcast, and the plan made anew
    assert movers and ["broadcast"] not in movers
