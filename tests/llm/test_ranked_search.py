import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from exposure.llm import ranked_search
from exposure.llm.ranked_search import Slice, search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = ["the", "The", "a", "über", "ÜBER", "İx", "x9", "日本", "deep", "rare", "sea", "a_b", "q'r", "\x00", "—", "zz", "of"]


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in set(items):
        found = []
        for doc, c in held:
            n = sum(c.values())
            m = 100 - 90 + 90 * n * n_docs // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        for rank, (s, _, doc) in enumerate(found[:k], 1):
            out[item, rank, doc, -s] += 1
    return out


def rows_of(frame):
    return Counter((r.item, r.rank, r.doc, r.score) for r in frame.collect())


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(n))


@pytest.mark.parametrize("slice_bytes", [300, 4_000_000])
@pytest.mark.parametrize("broadcast", [0, 32_000_000])
def test_against_brute_force(spark, monkeypatch, slice_bytes, broadcast):
    monkeypatch.setattr(ranked_search, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(ranked_search, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 500)
    monkeypatch.setattr(ranked_search, "STEP", 4)
    rng = random.Random(slice_bytes)
    docs = [(i, text(rng, rng.randrange(1, 40))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " -- "), (None, "rare deep sea"), (None, "the sea"), (3, docs[3][1]), docs[4]]
    docs += [(300 + i, docs[7][1]) for i in range(20)] + [(400, "the sea " * 3000)]
    items = [(i, text(rng, 12)) for i in range(12)]
    items += [(1, "deep sea"), (2, None), (None, "rare"), (90, ""), (91, "nowhere1"), items[5], (92, text(rng, 200))]
    d = spark.createDataFrame([(*x, 1, "k") for x in docs], "doc_id long, text string, score int, key string").repartition(7)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    assert rows_of(search(d, q, k=10)) == brute(docs, items, 10)


def test_empty_tables_and_text_ids(spark):
    d = spark.createDataFrame([("b", "deep sea"), ("a", "deep sea"), (None, "deep sea"), ("c", "land")], "doc_id string, text string")
    q = spark.createDataFrame([(7, "Deep")], "item_id int, text string")
    assert [tuple(r)[:3] for r in search(d, q, k=2).orderBy("rank").collect()] == [(7, 1, "a"), (7, 2, "b")]
    assert search(d.limit(0), q).count() == 0
    assert search(d, q.limit(0)).count() == 0


def test_masks_are_left_out():
    """Documents whose mask cannot reach the list are not scored."""
    n = 400
    docs = list(range(n))
    rare = np.arange(10, dtype=np.int32)
    part = Slice(
        docs, np.full(n, 5), ["common", "rare"], np.array([n, 10]), np.concatenate([np.arange(n, dtype=np.int32), rare]),
        np.ones(n + 10, np.int32), n, 5 * n)
    scored = []
    plain = part.scores
    part.scores = lambda which, *rest: scored.append(len(which)) or plain(which, *rest)
    found = part.best([("common", 1), ("rare", 5000)], [], 10)
    assert [x[2] for x in found] == list(range(10)) and sum(scored) < 50


def test_long_text_is_one_document(spark):
    d = spark.createDataFrame([(1, "deep sea " * 400_000), (2, "deep")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "deep sea")], "item_id long, text string")
    assert rows_of(search(d, q)) == brute([(1, "deep sea " * 400_000), (2, "deep")], [(7, "deep sea")], 10)


def test_row_groups_hold_few_slices(spark, monkeypatch):
    """A task decodes a row group at once, so many slices of one file must not share one."""
    monkeypatch.setattr(ranked_search, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(ranked_search, "GROUP_BYTES", 50_000)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(300))) for i in range(300)]
    held = ranked_search.index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(re.sub("^file:/*", "/", f)).metadata for f in held.inputFiles()]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 40 and max(g.num_rows for g in groups) <= 5
