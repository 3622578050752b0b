import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from exposure.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0D]+")


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    target = {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_words_taken(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "é", "zz", "src1", "src10", "n", "s"][: 3 + 3 * seed]
    rows = [(i, " ".join("w" * rng.randrange(0, 30)), rng.choice(sources), "x") for i in range(300)]
    rows += [(900, None, "a", "x"), (901, "\t \n", None, "x"), (902, "big " * 3000, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = {r.doc: r for r in M.placements(df).collect()}
    sizes = defaultdict(int)
    for i, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = water_fill(dict(sizes)), defaultdict(int)
    for i, t, s, _ in rows:
        r = got[i]
        assert r["size"] == len(WORD.findall(t or "")) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(c.taken for c in r.copies)
        assert all(0 <= c.position <= 1 for c in r.copies)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = {r.doc: r for r in M.placements(df.repartition(7)).collect()}
    assert again == got


def test_positions_follow_the_schedules(spark):
    """Half of the words of a source whose weight falls are placed before half of the time."""
    rows = [(i, "a b c d", "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = M.placements(df).join(df.withColumnRenamed("doc_id", "doc"), "doc").select("source", F.explode("copies").alias("c"))
    share = {r.source: r.share for r in placed.groupBy("source").agg(F.avg((F.col("c.position") < 0.5).cast("int")).alias("share")).collect()}
    assert abs(share["a"] - 0.625) < 0.01 and abs(share["b"] - 0.5) < 0.01 and abs(share["c"] - 0.375) < 0.01
    inverse = [M.training_time(F.lit(x), (1.5, 1.0, 0.5)).alias(f"x{i}") for i, x in enumerate((0.0, 0.3, 0.625, 0.9, 1.0))]
    t = spark.range(1).select(*inverse).first()
    assert [round(1.5 * v - v * v / 2, 9) for v in t] == [0.0, 0.3, 0.625, 0.9, 1.0]


def test_the_mix_itself(spark):
    rows = [(i, f"w{i} x\ty  z", "ab"[i % 2], 3, 0.5) for i in range(40)] + [(7, "same row here", "b", 1, 0.1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, position double")
    out = M.mixed(df).collect()
    want = M.placements(df)
    assert [r.position for r in out] == sorted(r.position for r in out)
    assert len(out) == want.select(F.sum(F.size("copies"))).first()[0]
    assert sum(r.taken_words for r in out) == want.select(F.sum("taken")).first()[0]
    assert all(len(WORD.findall(r.text)) == r.taken_words for r in out)
    assert M.mixed(df).columns == ["doc_id", "text", "source", "size", "copy_pass", "taken_words", "position"]


def test_no_words_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, " ", "a"), (None, "", "b")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in M.placements(df).collect()] == [(0, 0.0, 0)] * 3
    assert M.mixed(df).count() == 0
    assert M.placements(df.filter(F.lit(False))).count() == 0


def test_exploded_copies_are_not_broadcast(spark):
    """Spark sizes an explode as what goes in, so copies of a large corpus would pass the driver."""
    df = spark.createDataFrame([(i, "a b c d", "abc"[i % 3]) for i in range(30)], "doc_id long, text string, source string")
    plan = M.mixed(df)._jdf.queryExecution().executedPlan().toString()
    above, movers = [], []
    for row in plan.splitlines():
        depth = len(row) - len(row.lstrip(" :+-*()0123456789"))
        above = [(d, name) for d, name in above if d < depth]
        if "Generate explode(copies" in row:
            movers.append([name for _, name in above][-1:])
        if "Exchange" in row:
            above.append((depth, "broadcast" if "BroadcastExchange" in row else "shuffle"))
    assert movers and ["broadcast"] not in movers
