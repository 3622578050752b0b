"""Words of many texts at once, as 64-bit hashes in numpy.

A word is a run of bytes other than blank and the five ASCII controls from tab to
carriage return.  UTF-8 never uses these bytes inside a longer character, so words can
be cut on bytes.  Only these helpers see texts in Python; Spark decides which rows a
task holds, and a task hashes about a megabyte at a time, however large its batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER)
BASE = np.uint64(0xD1342543DE82EF95)  # odd, so that it has an inverse
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)``; the table is kept for the next call."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        size = max(n, 1024, 0 if held is None else 2 * len(held))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


@dataclass
class Words:
    """Words of ``n_docs`` texts, in order: hash, text number, byte range in ``data``."""

    data: bytes
    hashes: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_docs: int

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    @property
    def offsets(self) -> np.ndarray:
        """Where each text's words begin; one more entry than texts."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def _hash_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words in ``raw``, about PIECE_BYTES of text at a time."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + PIECE_BYTES, "right")))
        s, e = start[at:stop], end[at:stop]
        piece = raw[s[0]:e[-1]]
        body = piece[~SPACE[piece]]
        size = e - s
        first = np.cumsum(size) - size
        place = np.arange(len(body), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        weighed = _BYTE[body] * powers(BASE, int(size.max()))[place]
        out[at:stop] = np.add.reduceat(weighed, first)
        at = stop
    return mix(out + (end - start).astype(np.uint64) * _MULTIPLIER)


def read_words(texts: list[bytes | None], lower: bool = False) -> Words:
    """Words of the texts; a NULL text has none.  ``lower`` folds A-Z alone."""
    data = b"\n".join(t or b"" for t in texts)
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = _LOWER[raw]
    edges = np.diff(np.concatenate([[1], SPACE[raw].view(np.int8), [1]]).astype(np.int8))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    doc = np.searchsorted(np.cumsum(sizes), start, "right")
    hashes = _hash_words(raw, start, end) if len(start) else np.empty(0, np.uint64)
    return Words(data, hashes, doc, start, end, len(texts))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values; texts must be told apart by the caller."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, len(hashes)), dtype=np.uint64, out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(INVERSE, n) + np.uint64(width))


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every run of ``width`` words inside one text."""
    hashes = rolling(words.hashes, width)
    inside = np.flatnonzero(words.doc[: len(hashes)] == words.doc[width - 1:])
    return inside, hashes[inside]


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    ranked = np.sort(values)
    return ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])] if len(ranked) else ranked


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text.

    A text with fewer than ``width`` words has its whole word sequence as one shingle,
    one without words has none.
    """
    place, hashes = windows(words, width)
    counts = words.counts
    per_doc = np.maximum(counts - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    offsets = words.offsets
    out = []
    for i in range(words.n_docs):
        if per_doc[i]:
            out.append(distinct(hashes[bounds[i]:bounds[i + 1]]))
        elif counts[i]:
            whole = words.hashes[offsets[i]:offsets[i + 1]]
            out.append(rolling(whole, len(whole)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def in_pieces(texts: list[bytes | None], limit: int = 4 * PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text is one by itself."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or b"")
        if i > at and held + size > limit:
            yield at, i
            at, held = i, 0
        held += size
    if texts:
        yield at, len(texts)
