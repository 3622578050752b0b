"""Ranked lexical search by presence masks: the best documents of every item, exact.

Scores are integers in the manner of BM25.  A term is a run of letters, digits and characters
beyond ASCII, with A-Z in lower case.  With N documents that hold a term, L all their terms, n one
document's terms, df the documents of a term and tf its occurrences in one:

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    m = 10 + 90 n N div L
    score = sum over the item's distinct terms of w * (10^9 tf div (1000 tf + 8 m))

1. ``index`` deals the documents into slices of some ``SLICE_BYTES`` of text (a longer document is a slice by
   itself), each one row of a written table: its documents, sizes, terms and postings.  Row groups hold few slices,
   so a task's memory depends neither on the size of its part of the documents nor on the number of slices.
2. Items become lists of terms with weights; document frequencies are summed over the slices for
   the items' terms alone.  Nothing passes the driver but the sums N and L and the size of all items.
3. Every slice meets every item, in blocks of ``BLOCK_BYTES`` of items: a given set of queries against all
   rows.  Blocks are broadcast only if all items together are below ``BROADCAST_BYTES``; more are joined, and spread over as many
   keys as there are slices to read them.
4. In a slice, a document's mask has a bit per term of the item.  Documents are grouped by mask,
   and the highest score a mask can reach is the sum of what its terms reach at best in
   this slice.  Masks are taken by descending bound, and their documents scored, until the next
   bound lies below the tenth score met so far: what is left cannot enter the list.  A task
   carries its lists from slice to slice, so later ones stop sooner, and gives out ten rows per item.
5. The lists of all tasks are ranked by item; Spark cuts them to ten per task before it shuffles.

A NULL or empty text has no terms and does not count in N.  An item without terms, or without
documents above 0, has no rows.  Each row of ``docs`` is a document of its own, so a
repeated row is ranked again; rows of ``items`` that repeat id and text count once, and rows that
share an id but not the text are ranked apart.  Equal scores go by ascending id, NULL last.  Extra columns
are ignored.  No documents or no items give no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from exposure.llm.shared import stored

SLICE_BYTES = 4_000_000
BLOCK_BYTES = 4_000_000
BROADCAST_BYTES = 32_000_000
#: of a row group of slices, which a task that reads them decodes whole
GROUP_BYTES = 2_000_000
#: documents scored first, or those of one mask; every step takes twice as many as the one before
STEP = 32
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = re.compile(TERM)
_LOWER = str.maketrans(UPPER, LOWER)


# ---------------------------------------------------------------------------
# Index
# ---------------------------------------------------------------------------


def _numbered(text: str, numbers: dict[str, int]) -> Iterator[np.ndarray]:
    """Numbers of a text's terms, some at a time."""
    found = (m.group() for m in _TERM.finditer(text.translate(_LOWER)))
    while part := list(islice(found, 100_000)):
        yield np.array([numbers.setdefault(t, len(numbers)) for t in part], np.int64)


def _slice(name: int, docs: pa.Array, texts: list[str]) -> pa.RecordBatch:
    numbers: dict[str, int] = {}
    parts = [np.concatenate([np.zeros(0, np.int64), *_numbered(t, numbers)]) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    posted, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]) * len(texts) + doc, return_counts=True)
    terms, places = np.divmod(posted, max(1, len(texts)))
    dfs = np.bincount(terms, minlength=len(numbers))

    def one(values, kind) -> pa.Array:
        return pa.array([values], pa.list_(kind))

    return pa.RecordBatch.from_arrays(
        [
            pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
            one(sizes, pa.int64()), one(list(numbers), pa.string()), one(dfs.astype(np.int32), pa.int32()),
            one(places.astype(np.int32), pa.int32()), one(counts.astype(np.int32), pa.int32()),
            pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64()),
        ],
        names=["slice", "docs", "sizes", "terms", "dfs", "places", "counts", "n_docs", "n_terms"],
    )


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with a row per slice; postings lie in the order of ``terms``, ``dfs`` of each."""
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    schema = StructType().add("slice", LongType()).add("docs", ArrayType(rows.schema["doc"].dataType))
    schema = schema.add("sizes", ArrayType(LongType())).add("terms", ArrayType(StringType()))
    for name in ("dfs", "places", "counts"):
        schema = schema.add(name, ArrayType(IntegerType()))
    schema = schema.add("n_docs", LongType()).add("n_terms", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, n, start = [], 0, 0
            for i, text in enumerate(batch["text"]):
                texts.append(text.as_py() or "")
                n += len(texts[-1])
                if n >= SLICE_BYTES or i + 1 == len(batch):
                    yield _slice(name, batch["doc"][start:i + 1], texts)
                    texts, n, start, name = [], 0, i + 1, name + 1

    return stored(rows.mapInArrow(run, schema), GROUP_BYTES)


# ---------------------------------------------------------------------------
# Items
# ---------------------------------------------------------------------------


def _weighed(items: DataFrame, held: DataFrame, n_docs: int, item_col: str, text_col: str) -> DataFrame:
    """``(key, item, asked)``: the terms of each item that some document holds, with their weights."""
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    rows = items.select(
        F.struct(F.col(item_col).alias("item"), F.sha2(text_col, 256).alias("digest")).alias("key"), terms.alias("terms")
    ).dropDuplicates(["key"])
    asked = rows.select("key", F.explode("terms").alias("term"))
    posted = held.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), "x.dfs")
    dfs = posted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("dfs").alias("df"))
    ratio = F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")
    weights = dfs.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w")).filter("w > 0")
    return asked.join(weights, "term").groupBy("key").agg(F.collect_list(F.struct("term", "w")).alias("asked"))


def _met(held: DataFrame, weighed: DataFrame, n_bytes: int) -> DataFrame:
    """Every slice beside every block of items."""
    n_blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES))
    blocks = weighed.groupBy(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int").alias("block")).agg(
        F.collect_list(F.struct("key", "asked")).alias("items"))
    slices = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if n_bytes <= BROADCAST_BYTES:
        return slices.join(F.broadcast(blocks), "block")
    fan = max(1, held.count())
    spread = blocks.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
    return slices.withColumn("place", F.pmod(F.xxhash64("slice"), F.lit(fan)).cast("int")).join(spread, ["block", "place"])


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``first .. first + size - 1`` of all ranges, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(size.sum())


class Slice:
    """A slice's postings with their parts of a score, by term and by document."""

    def __init__(self, docs: list, sizes, terms: list[str], dfs, places, counts, n_docs: int, n_terms: int) -> None:
        self.docs = docs
        self.number = {t: i for i, t in enumerate(terms)}
        self.size = dfs.astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.place = places
        lengths, which = np.unique(sizes, return_inverse=True)
        m = np.array([10 + 90 * int(n) * n_docs // max(1, n_terms) for n in lengths], np.int64)[which]
        self.part = 1_000_000_000 * counts.astype(np.int64) // (1000 * counts.astype(np.int64) + 8 * m[places])
        self.most = np.maximum.reduceat(self.part, self.first) if len(terms) else self.part[:0]
        order = np.argsort(places, kind="stable")
        self.doc_part, self.doc_term = self.part[order], np.repeat(np.arange(len(terms)), self.size)[order]
        self.doc_size = np.bincount(places, minlength=len(docs))
        self.doc_first = np.cumsum(self.doc_size) - self.doc_size
        self.weight = np.zeros(len(terms), np.int64)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks as rows of bits, the documents that hold a term, and the mask of each."""
        n_words = -(-len(terms) // 64)
        held = np.zeros((len(self.docs), n_words), np.uint64)
        for bit, t in enumerate(terms.tolist()):
            docs = self.place[self.first[t]:self.first[t] + self.size[t]]
            held[docs, bit // 64] |= np.uint64(1 << bit % 64)
        docs = np.flatnonzero(held.any(axis=1))
        rows = np.ascontiguousarray(held[docs]).view(np.dtype((np.void, 8 * n_words))).ravel()
        distinct, which = np.unique(rows, return_inverse=True)
        words = distinct.view(np.uint64).reshape(-1, n_words)
        bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, :len(terms)]
        return bits, docs, which

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        size = self.doc_size[docs]
        at = _ranges(self.doc_first[docs], size)
        self.weight[terms] = weights
        parts = self.weight[self.doc_term[at]] * self.doc_part[at]
        self.weight[terms] = 0
        return np.add.reduceat(parts, np.cumsum(size) - size)

    def best(self, asked: list[tuple[str, int]], known: list[tuple], k: int) -> list[tuple]:
        """The ``k`` best of ``known`` and this slice's documents, each ``(-score, id is NULL, id)``."""
        here = [(self.number[t], w) for t, w in asked if t in self.number]
        if not here:
            return known
        terms, weights = (np.array(x, np.int64) for x in zip(*here))
        bits, docs, which = self.masks(terms)
        bound = bits @ (weights * self.most[terms])
        order = np.argsort(-bound, kind="stable")
        by_mask = docs[np.argsort(which, kind="stable")]
        size = np.bincount(which, minlength=len(bound))
        stop = np.cumsum(size[order])
        first = np.cumsum(size) - size
        at, step = 0, STEP
        while at < len(order):
            if len(known) == k and bound[order[at]] < -known[-1][0]:
                break
            done = stop[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(stop, done + step, "right")))
            step *= 2
            taken = order[at:until]
            chosen = by_mask[_ranges(first[taken], size[taken])]
            scored = self.scores(chosen, terms, weights).tolist()
            fresh = [(-s, self.docs[d] is None, self.docs[d]) for s, d in zip(scored, chosen.tolist()) if s > 0]
            known = heapq.nsmallest(k, known + fresh, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
            at = until
        return known


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """``(item, rank, doc, score)``: the ``k`` best documents of every item."""
    held = index(docs, id_col, text_col)
    sums = held.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = sums["n"] or 0, sums["l"] or 0
    n_bytes = items.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    weighed = _weighed(items, held, n_docs, item_col, text_col)
    met = _met(held, weighed, n_bytes).select("docs", "sizes", "terms", "dfs", "places", "counts", "items")
    out = StructType().add("key", weighed.schema["key"].dataType).add("doc", held.schema["docs"].dataType.elementType).add("score", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[tuple]] = {}
        kinds = None
        for batch in batches:
            kinds = (batch["items"].type.value_type.field("key").type, batch["docs"].type.value_type)
            for i in range(len(batch)):
                arrays = [batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "dfs", "places", "counts")]
                part = Slice(batch["docs"][i].as_py(), arrays[0], batch["terms"][i].as_py(), *arrays[1:], n_docs, n_terms)
                items = batch["items"][i].values
                keys, bounds = items.field("key").to_pylist(), items.field("asked").offsets.to_numpy()
                asked = items.field("asked").flatten()
                asked, bounds = list(zip(asked.field("term").to_pylist(), asked.field("w").to_pylist())), bounds - bounds[0]
                for key, a, b in zip(keys, bounds, bounds[1:]):
                    key = tuple(key.values())
                    best[key] = part.best(asked[a:b], best.get(key, []), k)
        rows = [(key, doc, -s) for key, found in best.items() for s, _, doc in found]
        if rows:
            names = ("item", "digest")
            yield pa.RecordBatch.from_arrays(
                [pa.array([dict(zip(names, r[0])) for r in rows], kinds[0]), pa.array([r[1] for r in rows], kinds[1]),
                 pa.array([r[2] for r in rows], pa.int64())], names=["key", "doc", "score"])

    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = met.mapInArrow(run, out).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("key.item").alias("item"), "rank", "doc", "score")
