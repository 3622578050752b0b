"""Byte-level BPE: texts to token ids by a file of ranks, and ids back to bytes.

A text is cut by the tokenizer's pattern and every piece is encoded by itself.  A piece that is
a token is that token.  Any other piece is encoded without running its merges:

1. Its bytes, read as Latin-1, pass through an Aho-Corasick automaton of all tokens, which
   gives the longest token that starts at each byte.
2. Two adjacent tokens are compatible if merging the bytes of both by rank gives these two
   again.  A row of tokens is what all merges of the piece would give exactly if all its neighbours are
   compatible: a merge across a border would already happen between the two tokens beside it.
   Compatibility is worked out once per pair and remembered.
3. From the left, the longest compatible token is taken; where none fits, the last token is
   given back and a shorter one tried.  The tokens up to one place are the same on every way
   there, so a place left once without success is never entered again: each place is tried
   once, and the time is linear in the piece.

With the public pattern a blank between two characters other than white space always starts a piece, so
texts are cut there first, and a word that comes again is looked up whole.

Ids are 32-bit.  The vocabulary (under a megabyte; at most ``MAX_BYTES``, checked) is read by the driver
and broadcast.  A task holds one Arrow batch and some eight bytes per byte of its longest
piece; remembered pieces and pairs are bounded and only save time.

A NULL or empty text has no ids and decodes to no bytes.  Every row gives a row: repeated rows
and NULL ids are nothing special.  Other columns are ignored by ``encode`` and kept by ``decode``.
No rows give no rows.  An id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

MAX_BYTES = 64_000_000
#: words, pieces and pairs that one Python worker remembers before older ones go
WORDS, PIECES, PAIRS = 250_000, 150_000, 300_000
#: longer pieces and words are not remembered
SHORT_PIECE = 64
#: fixed value: the pattern whose pieces start wherever a blank stands between two characters other than white space
BLANK_STARTS_PIECE = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: ids per batch handed back to Spark
BATCH_IDS = 1_000_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    rank = {}
    for line in raw.splitlines():
        if line.strip():
            token, number = line.split()
            rank[base64.b64decode(token)] = int(number)
    return rank


class Ranks:
    """A vocabulary of byte strings, where the rank of a token is its id."""

    def __init__(self, raw: bytes) -> None:
        self.rank = read_ranks(raw)
        self.none = max(self.rank.values(), default=0) + 1
        self.token = {i: t for t, i in self.rank.items()}
        self.size = {i: len(t) for t, i in self.rank.items()}
        self.shorter = {i: self._prefix(t) for t, i in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}

    def _prefix(self, token: bytes) -> int:
        """The longest token that ``token`` starts with, itself excluded; -1 if there is none."""
        return next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)

    def merged(self, data: bytes) -> list[int]:
        """All merges of ``data``, lowest rank first, then leftmost: the definition, for two tokens at a time."""
        rank, none = self.rank.get, self.none
        parts = [data[i:i + 1] for i in range(len(data))]
        joins = [rank(data[i:i + 2], none) for i in range(len(data) - 1)]
        while joins and (low := min(joins)) < none:
            at = joins.index(low)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(joins):
                joins[at] = rank(parts[at] + parts[at + 1], none)
        return [self.rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves ``right`` as it is after ``left`` (-1: at the start)."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            pair = [right] if left < 0 else [left, right]
            known = self._fits[key] = self.merged(b"".join(self.token[i] for i in pair)) == pair
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        size, shorter, known = self.size, self.shorter, self._fits.get
        option = array("i", [-1]) * len(piece)
        for end, i in self.automaton.iter(piece.decode("latin-1")):  # by end, so the longest comes last
            option[end + 1 - size[i]] = i
        path: list[int] = []
        dead: set[int] = set()
        before, at, n = -1, 0, len(piece)
        while at < n:
            i = option[at]
            while i >= 0:
                fits = known(before << 32 | i)
                if fits is None:
                    fits = self.fits(before, i)
                if fits and not (dead and at + size[i] in dead):
                    break
                i = shorter[i]
            if i >= 0:
                option[at] = shorter[i]
                path.append(i)
                at += size[i]
                before = i
            elif path:
                dead.add(at)
                at -= size[path.pop()]
                before = path[-1] if path else -1
            else:
                raise ValueError("the vocabulary cannot spell a piece")
        return path


class Encoder:
    """Texts to ids; words and pieces that come again are looked up."""

    def __init__(self, ranks: Ranks, pattern: str) -> None:
        self.ranks, self.pattern, self.splits = ranks, regex.compile(pattern), pattern in BLANK_STARTS_PIECE
        self.pieces, self.words = Remembered(PIECES), Remembered(WORDS)

    def _piece(self, piece: str) -> array:
        held = self.pieces.get(piece)
        if held is None:
            held = array("i", self.ranks.encode_piece(piece.encode()))
            self.pieces.put(piece, held)
        return held

    def _pieces(self, text: str) -> array:
        ids = array("i")
        for m in self.pattern.finditer(text):
            ids += self._piece(m.group())
        return ids

    def __call__(self, text: str | None) -> array:
        if not text or not self.splits:
            return self._pieces(text or "")
        first, *words = LONE_BLANK.split(text)
        ids, known = self._pieces(first), self.words.get
        for word in words:
            held = known(word)
            if held is None:
                if word.isalpha():  # letters alone are one piece
                    held = array("i", self.ranks.encode_piece(b" " + word.encode()))
                else:
                    held = self._pieces(" " + word)
                self.words.put(word, held)
                known = self.words.get
            ids += held
        return ids


class Remembered:
    """Ids of short strings; the older half goes when there are too many."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}
        self.get = self.young.get

    def put(self, text: str, ids: array) -> None:
        if len(text) <= SHORT_PIECE:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
                self.get = self._either
            self.young[text] = ids

    def _either(self, text: str) -> array | None:
        held = self.young.get(text)
        if held is None and (held := self.old.get(text)) is not None:
            self.young[text] = held
        return held


_workers: dict[object, object] = {}


def worker_copy(key, make):
    """One object per Python worker, made when first needed; a worker holds few of them."""
    if key not in _workers:
        if len(_workers) > 2:
            _workers.clear()
        _workers[key] = make()
    return _workers[key]


def read_vocabulary(path: str) -> bytes:
    """A tokenizer's file, of a size that may be broadcast."""
    with open(path, "rb") as f:
        raw = f.read(MAX_BYTES + 1)
    if len(raw) > MAX_BYTES:
        raise ValueError(f"{path} holds more than {MAX_BYTES} bytes")
    return raw


def shared_bytes(spark: SparkSession, path: str) -> tuple[Broadcast, str]:
    """A tokenizer's file for all tasks, and a name for what it holds."""
    raw = read_vocabulary(path)
    return spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()


def _listed(docs: pa.Array, ids: list[array]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(x) for x in ids], dtype=np.int32)
    flat = np.concatenate([np.frombuffer(x, np.int32) for x in ids if x] or [np.zeros(0, np.int32)])
    return pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc", "ids"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, ids)`` per row of ``docs``, without special tokens."""
    raw, key = shared_bytes(docs.sparkSession, ranks_path)
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_copy(("encode", key, pattern), lambda: Encoder(Ranks(raw.value), pattern))
        for batch in batches:
            held, n, start = [], 0, 0
            for i, text in enumerate(batch["text"]):
                held.append(encoder(text.as_py()))
                n += len(held[-1])
                if n >= BATCH_IDS or i + 1 == len(batch):
                    yield _listed(batch["doc"][start:i + 1], held)
                    held, n, start = [], 0, i + 1

    return rows.mapInArrow(run, StructType([rows.schema["doc"]]).add("ids", ArrayType(IntegerType())))


def token_table(raw: bytes) -> pa.Array:
    """The bytes of each id."""
    token = {i: t for t, i in read_ranks(raw).items()}
    return pa.array([token.get(i) for i in range(max(token, default=-1) + 1)], pa.binary())


def spelt_out(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """Tokens of all lists, taken at once, lie one after the other; lists end where their last token does."""
    ends = lists.offsets.to_numpy()
    taken = tokens.take(lists.values.slice(ends[0], ends[-1] - ends[0]))
    if taken.null_count:
        raise ValueError("an id outside the vocabulary")
    _, places, data = taken.buffers()
    places = np.frombuffer(places, np.int32)[:len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
    joined = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(places[ends - ends[0]].tobytes()), data or pa.py_buffer(b"")])
    return pc.if_else(lists.is_valid(), joined, None)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", data_col: str = "data") -> DataFrame:
    """``rows`` with the bytes that their ids stand for; NULL ids give NULL."""
    raw, key = shared_bytes(rows.sparkSession, ranks_path)
    schema = StructType([f for f in rows.schema if f.name != data_col]).add(data_col, BinaryType())
    kept = rows.select(*[c for c in rows.columns if c != data_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_copy(("decode", key), lambda: token_table(raw.value))
        for batch in batches:
            texts = spelt_out(batch[ids_col], tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, data_col])

    return kept.mapInArrow(run, schema)


def default_ranks() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
