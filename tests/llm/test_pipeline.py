import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from exposure.llm.quality import in_held_out_fold  # noqa: E402

from . import test_decontamination, test_jaccard_join, test_line_dedup, test_mixing  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(folder)
        out[name] = docs = spark.read.parquet(folder)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_of_documents_are_kept(steps):
    for name in ("quality", "lines", "near_duplicates", "benchmark"):
        assert steps[name].dtypes == steps["input"].dtypes


def test_the_classifier_keeps_good_documents_and_drops_junk(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(in_held_out_fold("doc_id"))
    kept = set(texts(steps["quality"]))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([(d in kept) == (q == 1) for d, q in truth.items()]) >= 0.9


def test_lines_against_brute_force(steps):
    before, after = texts(steps["quality"]), texts(steps["lines"])
    assert after == test_line_dedup.brute(list(before.items()), 20)
    assert steps["lines"].filter(F.col("n_chars") != F.length("text")).count() == 0


def test_near_duplicates_against_brute_force(steps):
    before, after = texts(steps["lines"]), texts(steps["near_duplicates"])
    ids = sorted(before)
    want = {d for d, (_, root) in zip(ids, test_jaccard_join.brute([before[d] for d in ids])) if d == ids[root]}
    assert set(after) == want and all(after[d] == before[d] for d in want)


def test_benchmark_against_brute_force(spark, steps):
    before, after = texts(steps["near_duplicates"]), texts(steps["benchmark"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = {tuple(w) for _, t in items for w in [x for x in test_decontamination.bag(t.lower().split())]}
    some = [(d, t) for d, t in before.items() if near & set(test_decontamination.bag((t or "").lower().split()))]
    leaked = {d for d, _ in test_decontamination.brute(some, items)}
    assert set(after) == set(before) - leaked


def test_the_mix_meets_its_targets(steps):
    before, after = steps["benchmark"].collect(), steps["mixing"].collect()
    sizes, taken = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(test_mixing.WORD.findall(r.text or ""))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + r.taken_words
    want = test_mixing.water_fill(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in sizes)
    assert [r.position for r in after] == sorted(r.position for r in after)


def test_no_rows_and_nulls(spark, steps):
    docs = steps["input"]
    nulls = docs.limit(3).select(*[F.lit(None).cast(k).alias(c) for c, k in docs.dtypes])
    for frame in (docs.limit(0), nulls.unionByName(docs.limit(20))):
        out = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
            assert out.count() >= 0


def unnamed(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_without_ids(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(7, words("a")), (None, words("a") + " more"), (None, words("b")), (None, words("c")), (None, words("c")), (None, words("c")),
            (None, words("d")), (None, words("d") + " more"), (None, None), (None, None), (8, words("e")), (8, words("f")), (9, words("f")), (9, words("g")),
            (9, words("g"))]
    for some in (rows, [r for r in rows if r[0] is None]):
        out = corpus_pipeline.one_of_each_group(spark, unnamed(spark, some), SF)
        got = sorted(((r.doc_id, (r.text or "").split(" ")[0][:1]) for r in out.collect()), key=str)
        named = [(7, "a"), (8, "e"), (8, "f"), (9, "g"), (9, "g")] if some is rows else [(None, "a")]
        assert got == sorted([*named, (None, "b"), (None, "c"), (None, "d"), (None, ""), (None, "")], key=str)


def test_benchmark_without_ids(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=lambda t: len((t or "").split()))
    rows = [(None, item), (None, "before " + item + " after"), (None, "a clean text"), (None, None), (1, item), (1, "another clean text"), (2, "clean")]
    out = corpus_pipeline.free_of_benchmark(spark, unnamed(spark, rows), SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(None, "a clean text"), (None, None), (1, "another clean text"), (2, "clean")], key=str)
