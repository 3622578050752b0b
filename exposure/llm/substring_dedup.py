"""Substring dedup with fixed-block anchors.

Removes each word that lies in a run of ``window`` consecutive words which also starts
anywhere else, in another text or in the same one.

* Index: non-overlapping blocks of ``(window + 1) // 2`` words of every text.  A run of
  ``window`` words always holds one whole block.
* Probe: the rolling windows of the same size of every text.  A window that equals an
  indexed block and occurs at least twice is a hit.  Fingerprints are compared per bucket;
  a false hit costs time, not correctness.
* Extend: around hits alone, the 64-bit hashes of all runs of ``window`` words are counted;
  neighbouring repeated runs join to maximal exact repeats.

Texts travel once: probing, extending and cutting read the same exchange of slices.  Hashes travel packed, one row per slice and bucket,
each distinct hash once: a passage that a third of all texts share is one entry per slice.
Buckets grow in number with the input, so none grows in size.

NULL texts and texts without words give no words.  Repeated rows are different places, so
each removes the other's long passages.  A NULL id stays NULL.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from exposure.llm import words as W
from exposure.llm.shared import sliced, text_megabytes

_PACKED = "bucket long, slice long, hashes binary, flags binary"
_HITS = "slice long, bucket long, hashes binary"
_REPEATED, _BLOCK = 1, 2
_OUT = "doc {kind}, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def _distinct(hashes: np.ndarray, in_block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with flags: seen twice or more, seen as a reference block."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    flags = (np.diff(np.concatenate([first, [len(ranked)]])) > 1).astype(np.uint8) * _REPEATED
    if in_block is not None and len(first):
        flags |= np.logical_or.reduceat(in_block[order], first).astype(np.uint8) * _BLOCK
    return ranked[first], flags


def _pack(slice_id: int, hashes: np.ndarray, flags: np.ndarray, buckets: int, kind) -> pa.RecordBatch:
    """One row per bucket; 32 further bits (``kind`` uint32) or all 64 are kept."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    kept = (hashes >> np.uint64(32)).astype(np.uint32) if kind is np.uint32 else hashes
    kept, flags, bucket = kept[order], flags[order], bucket[order]
    names, first = np.unique(bucket, return_index=True)
    bounds = [*first.tolist(), len(bucket)]
    return pa.RecordBatch.from_arrays([
        pa.array(names),
        pa.array(np.full(len(names), slice_id)),
        pa.array([kept[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
        pa.array([flags[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
    ], names=["bucket", "slice", "hashes", "flags"])


def _same_bucket(kind, need_block: bool):
    """Of one bucket, the hashes that occur twice or more (and as a block), for each slice."""

    def hits(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, kind) for x in table["hashes"].to_pylist()]
        every = np.concatenate(rows)
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in table["flags"].to_pylist()])
        order = np.argsort(every, kind="stable")
        ranked, flags = every[order], flags[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        often = np.add.reduceat(1 + (flags & _REPEATED).astype(np.int64), first) > 1
        if need_block:
            often &= np.bitwise_or.reduceat(flags, first) & _BLOCK > 0
        found = ranked[first][often]
        own = [x[_member(x, found)] for x in rows]
        some = [i for i, x in enumerate(own) if len(x)]
        rows_of = pa.array(some, pa.int64())
        return pa.table({
            "slice": table["slice"].take(rows_of),
            "bucket": table["bucket"].take(rows_of),
            "hashes": pa.array([own[i].tobytes() for i in some], pa.binary()),
        })

    return hits


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _texts(table: pa.Table):
    """The slice's texts, some megabytes at a time."""
    texts = table["text"].to_pylist()
    for a, b in W.in_pieces(texts):
        yield table.slice(a, b - a), W.read_words(texts[a:b])


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, n_words, n_removed, kept_text, removed)``, one row per input row.

    ``removed`` holds word ranges, end exclusive; ``kept_text`` joins what is left by blanks.
    """
    block = (window + 1) // 2
    megabytes = text_megabytes(docs, text_col)
    buckets = max(64, math.ceil(megabytes / 8))
    texts = sliced(docs, id_col, text_col, megabytes)
    many = np.uint64(buckets)

    def probe(own: pa.Table) -> pa.Table:
        found, blocks = [], []
        for _, words in _texts(own):
            place, hashes = W.windows(words, block)
            found.append(hashes)
            blocks.append((place - words.offsets[words.doc[place]]) % block == 0)
        hashes, flags = _distinct(np.concatenate(found), np.concatenate(blocks))
        return pa.Table.from_batches([_pack(own["slice"][0].as_py(), hashes, flags, buckets, np.uint32)])

    def extend(own: pa.Table, hit: pa.Table) -> pa.Table:
        anchors = [
            (np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32).astype(np.uint64)
            for b, x in zip(hit["bucket"].to_pylist(), hit["hashes"].to_pylist())
        ]
        parts = []
        if anchors and own.num_rows:
            known = np.sort(np.concatenate(anchors))
            for _, words in _texts(own):
                place, hashes = W.windows(words, block)
                names = ((hashes % many) << np.uint64(32)) | (hashes >> np.uint64(32))
                reached = np.zeros(len(words.hashes) + 1, np.int64)
                reached[place[_member(names, known)] + 1] = 1
                reached = np.cumsum(reached)
                start, runs = W.windows(words, window)
                parts.append(runs[reached[start + window - block + 1] > reached[start]])
        if not sum(map(len, parts)):
            return _empty(_PACKED)
        hashes, flags = _distinct(np.concatenate(parts))
        return pa.Table.from_batches([_pack(own["slice"][0].as_py(), hashes, flags, buckets, np.uint64)])

    def cut(own: pa.Table, hit: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, np.uint64) for x in hit["hashes"].to_pylist()]
        known = np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)
        out = {"doc": [], "n_words": [], "n_removed": [], "kept_text": [], "removed": []}
        for table, words in _texts(own) if own.num_rows else ():
            covered = np.zeros(len(words.hashes) + 1, np.int64)
            if len(known):
                start, runs = W.windows(words, window)
                start = start[_member(runs, known)]
                np.add.at(covered, start, 1)
                np.add.at(covered, start + window, -1)
            gone = np.cumsum(covered)[:-1] > 0
            offsets = words.offsets
            for i in range(words.n_docs):
                a, b = int(offsets[i]), int(offsets[i + 1])
                mask = gone[a:b]
                kept = np.flatnonzero(~mask) + a
                out["kept_text"].append(
                    b" ".join(words.data[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist())).decode()
                )
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
                out["removed"].append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])])
                out["n_words"].append(b - a)
                out["n_removed"].append(int(mask.sum()))
            out["doc"] += table["doc"].to_pylist()
        return pa.table(out, schema=_arrow(_OUT.format(kind="long"), doc=own.schema.field("doc").type))

    per_slice = texts.groupBy("slice")
    probes = per_slice.applyInArrow(probe, _PACKED)
    hits = probes.groupBy("bucket").applyInArrow(_same_bucket(np.uint32, True), _HITS)
    runs = per_slice.cogroup(hits.groupBy("slice")).applyInArrow(extend, _PACKED)
    repeats = runs.groupBy("bucket").applyInArrow(_same_bucket(np.uint64, False), _HITS)
    kind = dict(texts.dtypes)["doc"]
    return per_slice.cogroup(repeats.groupBy("slice")).applyInArrow(cut, _OUT.format(kind=kind))


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _arrow(schema: str, doc: pa.DataType | None = None) -> pa.Schema:
    fields = []
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        if kind.startswith("array"):
            kept = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        else:
            kept = doc if name == "doc" and doc is not None else _ARROW[kind]
        fields.append((name, kept))
    return pa.schema(fields)


def _empty(schema: str) -> pa.Table:
    return _arrow(schema).empty_table()
