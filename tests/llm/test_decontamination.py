import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from exposure.llm import decontamination as D

WORD = re.compile("[^\x20\x09-\x0D]+")


def bag(words):
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(docs, items):
    """Best similarity of each pair that reaches 0.75, over all windows."""
    out = {}
    split = lambda t: WORD.findall((t or "").lower())  # noqa: E731  ASCII texts
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v = split(item)
            size = min(len(v), len(w))
            if len(v) < 5 or size < 5:
                continue
            y = bag(v)
            for s in range(len(w) - size + 1):
                x = bag(w[s:s + size])
                alike = sum((x & y).values()) / sum((x | y).values())
                if alike >= 0.75:
                    out[d, i] = max(out.get((d, i), 0), alike)
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, item string, similarity double"),
        spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"),
    )


def data():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 45)))) for i in range(15)]
    items += [(90, None), (91, ""), (92, "one two three"), (93, items[0][1]), (94, "la la la la la la la la tra tra tra")]
    docs = []
    for d in range(360):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if d % 2:
            v = rng.choice(items[:15])[1].split()
            for _ in range(rng.randrange(0, 4)):
                p = rng.randrange(len(v))
                v[p:p + rng.randrange(2)] = [word()]
            w[5:5] = [x.upper() for x in v] if d % 3 else v[: rng.randrange(6, len(v) + 1)] if len(v) > 6 else v
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, items[3][1]), (503, items[3][1] + " x"), (504, "la " * 30 + "tra tra tra")]
    return docs, items


def test_against_all_windows(spark):
    docs, items = data()
    df, bench = frames(spark, docs, items)
    got = {(r.doc, r.item): r.similarity for r in D.find_leaks(df.repartition(3), bench).collect()}
    want = brute(docs, items)
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_more_shards_give_the_same(spark, monkeypatch):
    docs, items = data()
    df, bench = frames(spark, docs, items)
    one = {tuple(r) for r in D.find_leaks(df, bench).collect()}
    monkeypatch.setattr(D, "SHARD_BYTES", 1500)
    assert {tuple(r) for r in D.find_leaks(df, bench).collect()} == one


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(1)
    items = D.Items([" ".join(f"w{rng.integers(50)}" for _ in range(20)).encode() for _ in range(300)], 0.75, 5)
    for p in items.prints[:50]:
        flip = int(p)
        for b in rng.permutation(64)[: rng.integers(0, 30)]:
            flip ^= 1 << int(b)
        want = [i for i, q in enumerate(items.prints) if bin(int(q) ^ flip).count("1") <= items.radius]
        assert items.within_radius(flip).tolist() == want


def test_no_documents_no_items_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df, bench = frames(spark, [(1, text), (1, text), (None, text)], [(7, text)])
    assert sorted(((r.doc, r.start_word, r.end_word) for r in D.find_leaks(df, bench).collect()), key=str) == [
        (1, 0, 20), (1, 0, 20), (None, 0, 20)]
    assert D.find_leaks(df.filter(F.lit(False)), bench).count() == 0
    assert D.find_leaks(df, bench.filter(F.lit(False))).count() == 0
