"""Benchmark decontamination with SimHash windows.

A document window as long as a benchmark item is a leak when the weighted Jaccard similarity
of their five-word shingles, each weighing its number of occurrences, reaches a threshold.

* Windows.  Every start in every text counts.  A window and an item of k shingles can only
  reach t if they share 2 k t / (1 + t) of them, so running counts of shared shingles pass
  over all others without loss.
* Fingerprints.  A 64-bit SimHash of the window's weighted shingles.  At similarity t two
  fingerprints differ in ``64 * angle / pi`` bits on average; the radius is four deviations
  beyond that.
* Multi-index.  Both are cut into eight blocks.  Two fingerprints within radius r agree to
  r // 8 bits in one block at least, so the items whose blocks come that near, under any
  block, are all items within the radius.
* Verify.  The exact weighted similarity of the window's and the item's shingles.

Documents are read in one map stage and never move.  Items go to the tasks in shards of at
most ``SHARD_BYTES`` of text; a larger benchmark takes more passes, not more memory.

Texts are compared in lower case (A-Z).  A document shorter than an item is one window.
NULL or empty texts, and items of fewer words than one shingle, match nothing.  Repeated rows
are judged alike, and a repeated item is reported for each of its rows.  NULL ids stay NULL.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm import words as W

SHARD_BYTES = 8 << 20
BLOCKS = 8


def radius_at(similarity: float) -> int:
    """Bits that fingerprints of two sets of this Jaccard similarity stay within."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * p + 4 * math.sqrt(64 * p * (1 - p)))


def simhash(bits: np.ndarray) -> int:
    """Majority of every bit over rows of 64 bits."""
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes(), "big")


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(W.mix(hashes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def weighted_jaccard(one: np.ndarray, other: np.ndarray) -> float:
    """Of two bags of hashes."""
    both, n = np.unique(np.concatenate([one, other]), return_inverse=True)
    x = np.bincount(n[: len(one)], minlength=len(both))
    y = np.bincount(n[len(one):], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Items:
    """A shard of the benchmark: shingles, fingerprints, and blocks of near fingerprints."""

    def __init__(self, texts: list[bytes], similarity: float, shingle: int):
        words = W.read_words(texts, lower=True)
        place, hashes = W.windows(words, shingle)
        owner = words.doc[place]
        self.bags = [hashes[owner == i] for i in range(len(texts))]
        self.sizes = words.counts
        self.radius = radius_at(similarity)
        order = np.lexsort((owner, hashes))
        pairs = np.unique(np.stack([hashes[order], owner[order].astype(np.uint64)], axis=1), axis=0) if len(order) else np.empty((0, 2), np.uint64)
        self.owner = pairs[:, 1].astype(np.int64)
        self.shingles, first = np.unique(pairs[:, 0], return_index=True)
        self.bounds = np.concatenate([first, [len(pairs)]]).astype(np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.shingles >> np.uint64(48)).astype(np.int64)] = True
        self.prints = np.array([simhash(_bits(b)) if len(b) else 0 for b in self.bags], np.uint64)
        slack = self.radius // BLOCKS
        values = np.arange(256, dtype=np.uint8)
        parts = self.prints.astype(">u8").view(np.uint8).reshape(-1, BLOCKS)
        self.near = [np.bitwise_count(values[:, None] ^ parts[None, :, b]) <= slack for b in range(BLOCKS)]
        for b in range(BLOCKS):
            self.near[b][:, [not len(x) for x in self.bags]] = False

    def within_radius(self, fingerprint: int) -> np.ndarray:
        """All items whose fingerprint is within the radius."""
        some = np.zeros(len(self.prints), bool)
        for b, value in enumerate(fingerprint.to_bytes(BLOCKS, "big")):
            some |= self.near[b][value]
        some = np.flatnonzero(some)
        return some[np.bitwise_count(self.prints[some] ^ np.uint64(fingerprint)) <= self.radius]


def leaks_in(words: W.Words, items: Items, similarity: float, shingle: int) -> list[tuple[int, int, int, int, float]]:
    """``(text, item, first word, end word, similarity)``: the best window of every leaked item."""
    place, hashes = W.windows(words, shingle)
    maybe = np.flatnonzero(items.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
    if not len(maybe):
        return []
    at = np.searchsorted(items.shingles, hashes[maybe])
    at[at == len(items.shingles)] = 0
    known = items.shingles[at] == hashes[maybe]
    maybe, at = maybe[known], at[known]
    reps = items.bounds[at + 1] - items.bounds[at]
    if not reps.sum():
        return []
    item = _owners(items, at, reps)
    where = np.repeat(place[maybe], reps)
    doc = words.doc[where]
    counts, offsets = words.counts, words.offsets
    order = np.lexsort((where, item, doc))
    doc, item, where = doc[order], item[order], where[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    bounds = np.concatenate([first, [len(doc)]])
    share = similarity / (1 + similarity)
    k = items.sizes[item[first]] - shingle + 1
    own = np.minimum(counts[doc[first]] - shingle + 1, k)
    need = np.ceil(share * (k + own) - 1e-9).astype(np.int64)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    seen = set()
    for g in np.flatnonzero(np.diff(bounds) >= need):
        d, size = int(doc[first[g]]), int(own[g])
        base = int(offsets[d])
        spots = where[bounds[g]:bounds[g + 1]] - base
        starts = np.arange(max(0, spots[0] - size + 1), min(int(counts[d]) - shingle + 2 - size, spots[-1] + 1))
        shared = np.searchsorted(spots, starts + size) - np.searchsorted(spots, starts)
        from_place = int(np.searchsorted(place, base))
        for s in starts[shared >= need[g]].tolist():
            if (d, s, size) in seen:
                continue
            seen.add((d, s, size))
            bag = hashes[from_place + s:from_place + s + size]
            for i in items.within_radius(simhash(_bits(bag))).tolist():
                alike = weighted_jaccard(bag, items.bags[i])
                if alike >= similarity and alike > best.get((d, i), (0.0,))[0]:
                    best[d, i] = (alike, s, s + size + shingle - 1)
    return [(d, i, s, e, alike) for (d, i), (alike, s, e) in sorted(best.items())]


def _owners(items: Items, at: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """The items that own each of the shingles ``at``, one after the other."""
    begin = np.repeat(items.bounds[at], reps)
    step = np.arange(len(begin)) - np.repeat(np.cumsum(reps) - reps, reps)
    return items.owner[begin + step]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, shingle: int = 5, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(doc, item, start_word, end_word, similarity)``: per document row and item its best leaked window."""
    listed = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    n_bytes = listed.select(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(2 * n_bytes / SHARD_BYTES)) if n_bytes > SHARD_BYTES else 1
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    doc_kind, item_kind = dict(rows.dtypes)["doc"], dict(listed.dtypes)["item"]
    schema = f"doc {doc_kind}, item {item_kind}, start_word long, end_word long, similarity double"
    found = None
    for shard in range(shards):
        own = listed.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard).toPandas()
        names = own["item"].tolist()
        texts = [t.encode() for t in own["text"]]

        def scan(batches, names=names, texts=texts):
            items = Items(texts, similarity, shingle)
            for batch in batches:
                data = batch["text"].to_pylist()
                for a, b in W.in_pieces(data):
                    leaks = leaks_in(W.read_words(data[a:b], lower=True), items, similarity, shingle)
                    if leaks:
                        d, i, s, e, alike = zip(*leaks)
                        yield pa.RecordBatch.from_arrays([
                            batch["doc"].take(pa.array([a + x for x in d])),
                            pa.array([names[x] for x in i], item_type),
                            pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(alike, pa.float64()),
                        ], names=["doc", "item", "start_word", "end_word", "similarity"])

        item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_kind)
        part = rows.mapInArrow(scan, schema)
        found = part if found is None else found.union(part)
    return found
