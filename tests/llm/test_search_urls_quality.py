import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from exposure.llm import metric_search as M
from exposure.llm import quality as Q
from exposure.llm import url_filter as U


def brute_top(rows, k, every):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and len(v) == 6]
    out = []
    for q, x in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("size", [0.5, 5000.0])
def test_top_k_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(M, "PAGE", 16)
    monkeypatch.setattr(M, "BUCKET_PAGES", 3)
    monkeypatch.setattr(M, "BLOCK", 8)
    rng = np.random.default_rng(2)
    same = rng.normal(0, size, 6).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(0, size, 6).tolist()) for i in range(400)]
    rows += [(1000, None), (1005, []), (1010, [1.0] * 5 + [None]), (1015, [float("nan")] * 6), (1020, [float("inf")] + [0.0] * 5), (1025, [1.0, 2.0]),
             (1030, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, pivot string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in M.top_k(df, F.col("vec_id") % 5 == 0, 7).collect())
    assert got == brute_top(rows, 7, 5)


def test_top_k_of_few_and_of_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in M.top_k(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 2, 1024 * 3072), (0, 2, 1, 1024 * 2048)]
    assert M.top_k(df.filter(F.lit(False)), F.lit(True)).count() == 0


def test_pages_are_skipped_without_loss():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (40, 8))
    x = np.concatenate([c + rng.integers(-20, 20, (50, 8)) for c in centres]).astype(np.int64)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    pages = []
    for p in range(40):
        ids, own = np.arange(p * 50, p * 50 + 50), x[p * 50:p * 50 + 50]
        pivot = M._lifted(own[:1], top)[0]
        away = M._away(M._lifted(own, top), pivot[None, :])[:, 0]
        order = np.argsort(away)
        pages.append((ids[order], own[order], away[order], pivot, away.max()))
    opened = []

    class Watched(list):
        def __getitem__(self, at):
            opened.append(at)
            return super().__getitem__(at)

    got = M.best_of(x[7], 7, 5, top, Watched(pages))
    want = sorted((-int(s), i) for i, s in enumerate(x @ x[7]) if i != 7)[:5]
    assert got == [(-s, i) for s, i in want] and len(set(opened)) < 40


def test_urls(spark):
    rows = [("HTTP://WWW.Example.COM/en/A?q#f", "www.example.com", "/en/A", "www.example.com/en/", "allow"),
            ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
            ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"), ("http://notexample.com", "notexample.com", "", None, "allow"),
            ("x://b.net/es/porn", "b.net", "/es/porn", "net/es/", "block"), ("x://b.net/es", "b.net", "/es", None, "allow"),
            ("x://b.org/porn", "b.org", "/porn", None, "block"), ("x://b.org/pornograph", "b.org", "/pornograph", None, "allow"),
            ("x://b.org/free-win?hot", "b.org", "/free-win", None, "block"), ("x://b.org/free-free-win", "b.org", "/free-free-win", None, "allow"),
            ("x://b.org/sex_adult", "b.org", "/sex_adult", None, "block"), ("no scheme XXX", "", "", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
            ("://h#p/x?y", "h", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("x://" + "a" * 100_000 + ".com/", "a" * 100_000 + ".com", "/", "com/", "allow")]
    df = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df).collect()}
    assert [got[i] for i in range(len(rows))] == [r[1:] for r in rows]
    assert U.judge_urls(df.filter(F.lit(False))).count() == 0


def test_terms_count_once_and_need_free_edges():
    count = U.term_counter(["bad"], {"a b": 0.5, "b": 0.25}).func
    got = count(pd.Series(["bad.BAD/a b", "xbad bad9", None, "b-b"]))
    assert got.values.tolist() == [[1, 2, 0.75], [0, 0, 0], [0, 0, 0], [0, 1, 0.25]]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.scored(docs, Q.fit(docs, labels)).join(labels, "doc_id").filter(Q.in_held_out_fold("doc_id")).toPandas()
    assert all(zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id)
    right = (got.score >= Q.THRESHOLD) == (got.quality == 1)
    assert right.mean() >= 0.95 and right[got.quality == 0].mean() >= 0.85 and right[got.quality == 1].mean() >= 0.97


def test_held_out_labels_and_other_columns_have_no_say(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 7) for _ in range(30)) if i % 3 else "x | " * 9, "s") for i in range(300)]
    docs = spark.createDataFrame(rows + [(900, None, "s"), (None, "", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(Q.in_held_out_fold("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {r.doc_id: r.score for r in Q.scored(docs, Q.fit(docs, labels)).collect()}
    two = {r.doc_id: r.score for r in Q.scored(docs.withColumn("text", F.col("text")), Q.fit(docs.repartition(3), flipped)).collect()}
    assert one == pytest.approx(two) and len(one) == 302 and all(0 <= s <= 1 for s in one.values())
    assert np.mean([(one[i] >= 0.7) == (i % 3 > 0) for i in range(300)]) > 0.97


def test_labels_of_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for own in (labels, labels.filter(F.lit(False))):
        assert [r.score for r in Q.scored(docs, Q.fit(docs, own)).collect()] == [1.0, 1.0]
    assert Q.scored(docs.filter(F.lit(False)), Q.fit(docs, labels)).count() == 0
