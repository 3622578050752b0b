import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposure.llm import jaccard_join as J
from exposure.llm import words as W
from exposure.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(rng, n):
    base = [[rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(rng.choice([3, 8, 40, 120, 400]))] for _ in range(6)]
    boiler = [f"b{i}" for i in range(40)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, max(2, len(w) // 12))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w = boiler + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
        if rng.random() < 0.2:
            w = [x.upper() for x in w]
        texts.append(rng.choice([" ", "\n"]).join(w))
    return texts + [None, "", " \t", "one", "One", "a b c", "A B C", texts[0], texts[0], "é É"]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(random.Random(seed), 220)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n int, root string")
    got = {r.doc: (r.n_shingles, r.component) for r in J.jaccard_components(df.repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_hot_groups_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: (r.n_shingles, r.component) for r in J.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_published_blocks_meet_within_the_bound():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = int(rng.integers(0, len(a) // 3 + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 75 * (len(a) + len(b) - same):
            flags = [W.mix(x) % np.uint64(3) == 0 for x in (a, b)]
            assert np.intersect1d(J.published(a, flags[0], 75), J.published(b, flags[1], 75)).size
            apart = len(a) + len(b) - 2 * same
            assert J.sketch_distance(J.sketch_of(a), J.sketch_of(b)) <= apart <= J.most_apart(len(a) + len(b), 75)


def test_no_rows_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None)],
                               "doc_id long, text string")
    got = sorted(((r.doc, r.n_shingles, r.component) for r in J.jaccard_components(df).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 0, None), (None, 2, 1)]
    assert J.jaccard_components(df.filter(F.lit(False))).count() == 0


def test_components_of_a_chain_and_of_no_links(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(chain).collect()} == {0} and components(chain).count() == 61
    assert components(chain.filter("a < 0")).count() == 0
