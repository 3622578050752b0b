import base64
import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from exposure.llm import byte_bpe, token_alignment
from exposure.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
POOL = ["a", "é", "😀", " ", "  ", "\n", "\t", "　", "\xa0", "\x1c", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>",
        "12", "3", "日本", "ﬁ", "é", "▁", "\x00", "​", "'s", ".", "Word", "the", "\x85", " "]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    path, pattern = byte_bpe.default_ranks()
    held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=held, special_tokens={})


def test_same_ids_as_the_library(spark, ranks):
    texts = odd_texts(300) + [None, "", "ab" * 20_000, "x" * 1_200_000, "the same", "the same"]
    rows = spark.createDataFrame([(i if i % 7 else None, t, [1], "d") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, doc string")
    path, pattern = byte_bpe.default_ranks()
    told = byte_bpe.decode(byte_bpe.encode(rows.repartition(5), path, pattern), path).collect()
    assert len(told) == len(texts)
    want = Counter((i if i % 7 else None, tuple(ranks.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts))
    assert Counter((r.doc, tuple(r.ids), bytes(r.data)) for r in told) == want
    assert byte_bpe.encode(rows.limit(0), path, pattern).count() == 0
    kept = byte_bpe.decode(spark.createDataFrame([(1, None, b"x")], "doc int, ids array<int>, data binary"), path).collect()
    assert kept[0].asDict() == {"doc": 1, "ids": None, "data": None}


@pytest.mark.parametrize("seed", range(4))
def test_backtracking_equals_merging(seed):
    """A vocabulary with ranks dealt at random, whose longest tokens are often not what merging gives."""
    rng = random.Random(seed)
    tokens = {bytes([b]) for b in b"abc"}
    while len(tokens) < 40:
        tokens.add(rng.choice(sorted(tokens)) + rng.choice(sorted(tokens)))
    order = sorted(tokens, key=lambda t: (len(t) > 1, rng.random()))
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order))
    ours = byte_bpe.Ranks(lines)
    for _ in range(400):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        assert ours.encode_piece(piece) == ([ours.rank[piece]] if piece in ours.rank else ours.merged(piece))
    with pytest.raises(ValueError):
        ours.encode_piece(b"abz")


def test_op13_on_documents(spark, ranks):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for d in docs:
        ids = ranks.encode_ordinary(d.text or "")
        want[d.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_byte_bpe"](spark, SF).collect()} == want


def aligned(texts):
    """Groups and links of whole texts from ids and decoded bytes alone."""
    a_path, b_path = token_alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    table = token_alignment.byte_of_character()
    out = []
    for text in texts:
        out.append(("", []))
        if not text:
            continue
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        x_bytes = [bytes(table[c] for c in t) for t in x.tokens]
        y_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, b.id_to_piece(y))]
        if not b"".join(x_bytes) == b"".join(y_bytes) == (" " + text).encode():
            continue
        x_ends, y_ends = np.cumsum([len(t) for t in x_bytes]).tolist(), np.cumsum([len(t) for t in y_bytes]).tolist()
        groups, links, before = [], [], 0
        for end in sorted(set(x_ends) & set(y_ends)):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if before < e <= end) for ids, ends in ((x.ids, x_ends), (y, y_ends))))
            links.append((x.ids[x_ends.index(end)], y[y_ends.index(end)], len(x.ids), len(y)))
            before = end
        out[-1] = (";".join(groups), links)
    return out


def expected(docs, texts):
    held = aligned(texts)
    counts = Counter(link[:2] for _, links in held for link in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return Counter(
        (doc, links[0][2] if links else 0, links[0][3] if links else 0, len(links), len(links),
         sum(counts[x[:2]] == highest[x[1]] for x in links), sum(counts[x[:2]] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if links else "")
        for doc, (groups, links) in zip(docs, held)
    )


def test_alignment_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 500)
    texts = odd_texts(400) + [None, "", " ", "x" * 3000, "the same", "the same", "a " * 4000, "▁", "ok then"]
    docs = [i if i % 7 else None for i in range(len(texts))]
    rows = [(d, t, "c", 5) for d, t in zip(docs, texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, chunk string, pairs int").repartition(6)
    told = token_alignment.linked(frame, *token_alignment.default_paths()).collect()
    assert Counter(map(tuple, told)) == expected(docs, texts)
    assert token_alignment.linked(frame.limit(0), *token_alignment.default_paths()).count() == 0


def test_op12_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000")
    held = docs.collect()
    told = token_alignment.linked(docs, *token_alignment.default_paths()).collect()
    assert Counter(map(tuple, told)) == expected([d.doc_id for d in held], [d.text for d in held])


@pytest.fixture()
def tokenizers():
    return token_alignment.Tokenizers(*(open(path, "rb").read() for path in token_alignment.default_paths()))


def test_words_that_do_not_come_again_take_no_memory(tokenizers):
    words = (f"{chr(97 + i % 26)}{i}" for i in range(60_000))
    chunks = [[" ".join(next(words) for _ in range(200)) for _ in range(100)] for _ in range(3)]
    tracemalloc.start()
    try:
        for n, texts in enumerate(chunks):
            for batch in token_alignment._chunk(tokenizers, n, pa.array(range(100)), texts):
                del batch
        del chunks, texts
        assert tracemalloc.get_traced_memory()[0] < 10_000_000
    finally:
        tracemalloc.stop()


def test_words_remembered_and_forgotten(tokenizers, monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 40)
    monkeypatch.setattr(token_alignment, "GROUPS_BYTES", 300)
    rng = random.Random(5)
    words = [w for t in odd_texts(60, seed=3) for w in t.split(" ")] + [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(300)] + [" ", "", "a  b c"]
    told, places = [], []
    for n in range(0, len(texts), 20):
        some = list(texts[n:n + 20])
        batches = list(token_alignment._chunk(tokenizers, n, pa.array(range(n, n + len(some))), some))
        assert len(tokenizers.row) == len(tokenizers.used) <= 40
        pairs = batches[-1]["pairs"][0].as_py()
        rows = [r for b in batches[:-1] for r in b.to_pylist()]
        told += [(r["groups"], r["n_a"], r["n_b"], [pairs[i] for i in r["links"]]) for r in rows]
        places += [r["doc"] for r in rows]
        assert batches[-1]["counts"][0].as_py() == [sum(r["links"].count(i) for r in rows) for i in range(len(pairs))]
    want = [(g, *(x[0][2:] if x else (0, 0)), [a << 32 | b for a, b, *_ in x]) for g, x in aligned(texts)]
    assert places == list(range(len(texts))) and told == want


def test_spans_give_way_to_bytes():
    """Parts of one character report the whole of it; their ends come from the decoded bytes."""
    spans, sizes = np.array([(0, 2), (2, 6), (2, 6), (6, 7)]), np.array([2, 1, 3, 1])
    assert token_alignment.refined(spans, sizes).tolist() == [2, 3, 6, 7]
    with pytest.raises(ValueError):
        token_alignment.refined(spans, np.array([2, 0, 4, 1]))
