import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from exposure.llm.substring_dedup import dedup_substrings

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    runs = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if runs[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [5, 6, 35])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    shared = [[f"s{k}x{i}" for i in range(50)] for k in range(3)]
    texts = []
    for d in range(60):
        w = [rng.choice("abcdé") + str(rng.randrange(500)) for _ in range(rng.randrange(0, 90))]
        if d % 2:
            cut = rng.randrange(0, 16)
            w[10:10] = rng.choice(shared)[cut:cut + rng.randrange(4, 50)]
        texts.append("\t ".join(w))
    texts += [texts[3], None, "", "  \n", "x " * 300, "word"]
    rows = [(i, t, "z", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slice string, row int").repartition(5)
    got = {r.doc: (r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(df, window).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc, r.n_words, r.n_removed) for r in dedup_substrings(df).collect()), key=str)
    assert got == [(1, 40, 40), (1, 40, 40), (2, 0, 0), (None, 2, 0)]
    assert dedup_substrings(df.filter(F.lit(False))).count() == 0


def test_removed_ranges_and_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "start " + " ".join(f"w{i}" for i in range(100, 140)) + " end")],
                               "doc_id long, text string")
    got = {r.doc: r for r in dedup_substrings(df).collect()}
    assert [tuple(x) for x in got[1].removed] == [(100, 140)]
    assert [tuple(x) for x in got[2].removed] == [(1, 41)] and got[2].kept_text == "start end"
