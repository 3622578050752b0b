"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Tokenizer A is byte-level BPE (a ``tokenizers`` file) and reads a blank and the text; tokenizer B
is a sentencepiece model, which adds that blank itself.  Both cover the same bytes:

1. Coarse cuts are the character offsets that A reports and the byte spans that B reports.
2. Where tokens share a character (A's parts of a multibyte character) or a span is empty (B's
   byte-fallback tokens), the span is longer or shorter than the token; the cuts inside
   are refined by the lengths of the tokens' decoded bytes.
3. Byte offsets where a token of A and one of B both end cut the text into groups, and link the
   tokens that end there.

A text whose decoded tokens do not spell a blank and the text has no tokens, and so has a NULL
or empty one.

**Words.**  A blank between two characters that are not white space always starts a new token
in both tokenizers (``Tokenizers.splits`` checks that the files promise it), so a text is the row of its words, and
a word's groups do not depend on its neighbours.  A chunk (below) aligns a word once, and a worker remembers words that
come again in columns, so that a word takes few bytes: one is let in at its second occurrence, and the longest unused go
first.  A long text is never encoded in one piece.  With other files whole texts are words.

**Counts of links.**  A task collects documents into chunks of some ``CHUNK_BYTES`` of text (a longer document
is a chunk by itself) and numbers the distinct links of a chunk, so a pair of ids that occurs in every text is one row
per chunk.  These rows are summed over the corpus, compared per id of B, and joined back
to the chunks, where documents add them up.  The chunks are a written table: a task that runs again
numbers them anew, but only one outcome is ever read.  No task holds more than a chunk (of the groups
as text only ``GROUPS_BYTES`` or one document's), the remembered words, and the rows of one id of B, of which there are at
most as many as ids of A.

Every input row gives a row; repeated rows count as often as they occur, and rows with NULL ids
like others.  Extra columns are ignored.  No rows give no rows.  Both files are read by the driver (their size
is checked) and broadcast.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from sentencepiece import sentencepiece_pb2
from tokenizers import Tokenizer

from exposure.llm.byte_bpe import shared_bytes, worker_copy
from exposure.llm.shared import stored

CHUNK_BYTES = 4_000_000
#: text of groups that leaves a task at once
GROUPS_BYTES = 2_000_000
#: words remembered by one Python worker before half of them go, and the length up to which they are
REMEMBERED, SHORT_WORD = 300_000, 64
#: places (a power of two) for hashes of words met once; emptied when a quarter is taken
MET = 1 << 23
#: bytes of words that are encoded at once
ENCODED_BYTES = 20_000
_LONE_BLANK, _TWO_SPACES = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for.

    Visible characters of Latin-1 stand for themselves, the other bytes in order for U+0100 and on.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words(NamedTuple):
    """Aligned words in columns: numbers of tokens (of A -1 where a tokenizer does not spell the word), groups as text,
    numbers of links, and the links ``a << 32 | b`` of all words one after the other."""

    n_a: np.ndarray
    n_b: np.ndarray
    groups: list[str]
    n_links: np.ndarray
    links: np.ndarray

    def take(self, rows: np.ndarray) -> Words:
        n = self.n_links[rows]
        links = self.links[ranges((np.cumsum(self.n_links) - self.n_links)[rows], n)]
        return Words(self.n_a[rows], self.n_b[rows], [self.groups[i] for i in rows.tolist()], n, links)


def joined(parts: list[Words]) -> Words:
    none = np.zeros(0, np.int64)
    n_a, n_b, n_links, links = (np.concatenate([none, *[p[k] for p in parts]]) for k in (0, 1, 3, 4))
    return Words(n_a, n_b, list(chain.from_iterable(p.groups for p in parts)), n_links, links)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each ``first`` on, one range after the other."""
    out = np.repeat(first - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_raw: bytes, b_raw: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.a = Tokenizer.from_str(a_raw.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_raw)
        table = byte_of_character()
        added = {t["id"]: t["content"].encode() for t in json.loads(a_raw)["added_tokens"]}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [added[i] if i in added else bytes(table[c] for c in name) for i, name in enumerate(names)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.splits = self._splits(json.loads(a_raw), pieces)
        self.row: dict[str, int] = {}  # of remembered words in the columns
        self.known, self.used, self.chunks = joined([]), np.zeros(0, np.int64), 0
        self.met, self.n_met = np.zeros(MET, bool), 0
        # ids as text with what may follow them: , | in A and , ; and the end of a word in B
        self.told = [f"{i}{mark}" for mark in ",|" for i in range(len(names))]
        self.told += [f"{i}{mark}" for mark in ",;\n" for i in range(len(pieces))]

    def _splits(self, a: dict, pieces: list[str]) -> bool:
        """Whether a lone blank always starts a token: A by its pattern, B as no piece goes on after one."""
        cut = a.get("pre_tokenizer") or {}
        plain = a.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        whole = not any(re.search("[^▁]▁", p) for p in pieces)
        same = self.b.normalize("x  \ufb01\u212b  y ") == "▁x▁▁\ufb01\u212b▁▁y▁"
        return bool(plain and whole and same)

    def words(self, text: str) -> list[str]:
        if not self.splits:
            return [text]
        if text[0] == " " or text[-1] == " " or _TWO_SPACES.search(text):
            return _LONE_BLANK.split(text)
        return text.split(" ")  # every blank is a lone one

    def align(self, words: list[str], times: np.ndarray) -> Words:
        """A list without repeats, and how often each word occurs."""
        rows = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        fresh = [words[i] for i in new.tolist()]
        # words that begin and end with a character other than white space are encoded as one text, with blanks between
        loose = np.array([not (self.splits and w and not w[0].isspace() and not w[-1].isspace()) for w in fresh], bool)
        order = np.argsort(loose, kind="stable")
        fresh, new, n_tight = [fresh[i] for i in order.tolist()], new[order], int((~loose).sum())
        parts = [self.known]
        start = n = 0
        for i, word in enumerate(fresh):
            n += len(word)
            if n >= ENCODED_BYTES or i + 1 in (n_tight, len(fresh)):
                some = fresh[start:i + 1]
                parts.append((self._run(some) if i < n_tight else None) or self._one_by_one(some))
                start, n = i + 1, 0
        known = joined(parts)
        rows[new] = len(self.used) + np.arange(len(new))
        self._remember(known, fresh, times[new], rows)
        return known.take(rows)

    def _remember(self, known: Words, fresh: list[str], times: np.ndarray, rows: np.ndarray) -> None:
        """Words met before go behind the remembered ones; when there are too many, half go."""
        place = np.fromiter(map(hash, fresh), np.int64, len(fresh)) & (MET - 1)
        again = (times > 1) | self.met[place]
        self.n_met += len(place)
        if self.n_met > MET // 4:
            self.met[:], self.n_met = False, len(place)
        self.met[place] = True
        again &= np.fromiter(map(len, fresh), np.int64, len(fresh)) <= SHORT_WORD
        n, self.chunks = len(self.used), self.chunks + 1
        used = np.concatenate([self.used, again - 1])
        used[rows] = np.where(used[rows] < 0, -1, self.chunks)
        kept = np.flatnonzero(used >= 0)
        words = chain(self.row, fresh)
        if len(kept) > REMEMBERED:
            kept = np.sort(kept[np.argsort(-used[kept], kind="stable")[:REMEMBERED // 2]])
            at = np.full(len(used), -1)
            at[kept] = np.arange(len(kept))
            self.row = {w: i for w, i in zip(words, at.tolist()) if i >= 0}
        else:
            self.row.update(zip((fresh[i] for i in np.flatnonzero(again).tolist()), count(n)))
        self.known, self.used = known.take(kept), used[kept]

    def _run(self, words: list[str]) -> Words | None:
        text = " ".join(words)
        of_a = self.a.encode(" " + text, add_special_tokens=False)
        b, spans = _pieces(self.b.encode(text, return_type="serialized_proto"))
        a = of_a.ids
        limits = np.cumsum([1 + len(w) for w in words] if text.isascii() else [1 + len(w.encode()) for w in words])
        if not self._spelt(text, a, b):
            return None
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_stop = np.searchsorted(np.cumsum(self.a_size[a_ids]), limits) + 1
        b_stop = np.searchsorted(np.cumsum(self.b_size[b_ids]), limits) + 1
        a_spans = _byte_spans(of_a.offsets, " " + text)
        return self._matched(limits, a_ids, a_spans, np.diff(a_stop, prepend=0), b_ids, spans, np.diff(b_stop, prepend=0))

    def _one_by_one(self, words: list[str]) -> Words:
        of_a = self.a.encode_batch([f" {w}" for w in words], add_special_tokens=False)
        parts, none = [], np.zeros(1, np.int64)
        for word, x, y in zip(words, of_a, self.b.encode(words, return_type="serialized_proto", num_threads=1)):
            a, (b, spans) = x.ids, _pieces(y)
            if self._spelt(word, a, b):
                a_spans = _byte_spans(x.offsets, " " + word)
                limit = np.array([1 + len(word.encode())])
                parts.append(self._matched(limit, np.array(a, np.int64), a_spans, np.array([len(a)]), np.array(b, np.int64), spans, np.array([len(b)])))
            else:
                parts.append(Words(none - 1, none, [""], none, none[:0]))
        return joined(parts)

    def _spelt(self, word: str, a: list[int], b: list[int]) -> bool:
        data = b" " + word.encode()
        return b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b])

    def _matched(self, limits, a, a_spans, n_a, b, b_spans, n_b) -> Words:
        """Words one after the other, that end at the bytes ``limits``; ids, spans and numbers of tokens per word."""
        a_ends, b_ends = refined(a_spans, self.a_size[a]), refined(b_spans, self.b_size[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        # in the order of groups, and in a group A before B
        a_key, b_key = 2 * np.searchsorted(ends, a_ends), 2 * np.searchsorted(ends, b_ends) + 1
        key = np.concatenate([a_key, b_key])
        order = np.argsort(key, kind="stable")
        a_last = np.append(a_key[1:] != a_key[:-1], True)
        b_last = np.append(b_key[1:] != b_key[:-1], True)
        word_end = np.isin(b_ends, limits, assume_unique=True)
        marks = np.concatenate([a + a_last * len(self.a_bytes), b + 2 * len(self.a_bytes) + (b_last + word_end * 1) * len(self.b_bytes)])
        groups = "".join(map(self.told.__getitem__, marks[order].tolist())).split("\n")
        links = a[a_last] << 32 | b[b_last]
        n_links = np.diff(np.searchsorted(ends, limits, "right"), prepend=0)
        return Words(n_a, n_b, groups[:len(limits)], n_links, links)


def _pieces(proto: bytes) -> tuple[list[int], np.ndarray]:
    """Ids, and the byte spans in a blank and the text, of a sentencepiece result."""
    pieces = sentencepiece_pb2.SentencePieceText.FromString(proto).pieces
    spans = np.zeros((len(pieces), 2), np.int64)
    spans[:, 1] = [p.end for p in pieces]
    spans[:, 1] += 1
    spans[1:, 0] = spans[:-1, 1]  # a piece begins where the last one ends; the added blank belongs to the first
    return [p.id for p in pieces], spans


def _byte_spans(offsets: list[tuple[int, int]], text: str) -> np.ndarray:
    """Character offsets as byte spans."""
    spans = np.fromiter(chain.from_iterable(offsets), np.int64, 2 * len(offsets)).reshape(-1, 2)
    if text.isascii():
        return spans
    units = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    place = np.concatenate([[0], np.cumsum(1 + (units > 0x7F) + (units > 0x7FF) + (units > 0xFFFF))])
    return place[spans]


def refined(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends: those of the spans, and sums of decoded sizes where spans are not their token's own."""
    if not sizes.all():
        raise ValueError("a token without bytes has no place of its own")
    sums = np.cumsum(sizes)
    own = (spans[:, 1] - spans[:, 0] == sizes) & (spans[:, 1] == sums)
    return np.where(own, spans[:, 1], sums)


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, and one more per chunk with the distinct links of its documents.

    ``(chunk, doc, n_a, n_b, n_groups, n_links, groups, links)``: ``links`` are places in ``pairs`` of the chunk's
    own row ``(chunk, pairs, counts)``, where the other columns but ``chunk`` are NULL.  Chunk numbers are those of one
    run of the tasks: write the table before it is read twice.
    """
    (a_raw, a_key), (b_raw, b_key) = shared_bytes(docs.sparkSession, a_path), shared_bytes(docs.sparkSession, b_path)
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    schema = StructType([rows.schema["doc"]])
    for name in ("chunk", "n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, LongType())
    schema = schema.add("groups", StringType()).add("links", ArrayType(IntegerType()))
    schema = schema.add("pairs", ArrayType(LongType())).add("counts", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = worker_copy(("align", a_key, b_key), lambda: Tokenizers(a_raw.value, b_raw.value))
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, n, start = [], 0, 0
            for i, text in enumerate(batch["text"]):
                texts.append(text.as_py() or "")
                n += len(texts[-1])
                if n >= CHUNK_BYTES or i + 1 == len(batch):
                    yield from _chunk(both, chunk, batch["doc"][start:i + 1], texts)
                    texts, n, start, chunk = [], 0, i + 1, chunk + 1

    return rows.mapInArrow(run, schema)


def _chunk(both: Tokenizers, chunk: int, docs: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    vocabulary: dict[str, int] = defaultdict(count().__next__)
    bodies = [np.fromiter(map(vocabulary.__getitem__, both.words(text) if text else ()), np.int64) for text in texts]
    texts.clear()
    of_doc = np.repeat(np.arange(len(bodies)), [len(x) for x in bodies])
    none = np.zeros(0, np.int64)
    every = np.concatenate([none, *bodies])
    words = both.align(list(vocabulary), np.bincount(every, minlength=len(vocabulary)))
    del vocabulary
    unspelt = np.unique(of_doc[words.n_a[every] < 0])
    if len(unspelt):
        for i in unspelt.tolist():
            bodies[i] = none
        kept = ~np.isin(of_doc, unspelt)
        every, of_doc = every[kept], of_doc[kept]
    n = len(bodies)
    n_a, n_b, n_links = (_sums(of_doc, x[every], n) for x in (words.n_a, words.n_b, words.n_links))
    # links of words as places among the distinct ones of all words, then of documents
    pairs, place = np.unique(words.links, return_inverse=True)
    first = np.cumsum(words.n_links) - words.n_links
    flat = place.astype(np.int32)[ranges(first[every], words.n_links[every])]
    counts = np.bincount(flat, minlength=len(pairs))
    ends = np.concatenate([[0], np.cumsum(n_links)])
    del place, every, of_doc
    names = ["doc", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs", "counts"]
    long = pa.list_(pa.int64())
    groups, size, start = [], 0, 0
    for i, body in enumerate(bodies):
        groups.append(";".join(map(words.groups.__getitem__, body.tolist())))
        size += len(groups[-1])
        if size >= GROUPS_BYTES or i + 1 == n:
            some = slice(start, i + 1)
            numbers = [pa.array(x[some]) for x in (n_a, n_b, n_links, n_links)]
            at = (ends[start:i + 2] - ends[start]).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(at), pa.array(flat[ends[start]:ends[i + 1]]))
            m = len(groups)
            yield pa.RecordBatch.from_arrays(
                [docs[start:i + 1], pa.array(np.full(m, chunk)), *numbers, pa.array(groups, pa.string()), links, pa.nulls(m, long), pa.nulls(m, long)],
                names=names)
            groups, size, start = [], 0, i + 1
    empty = [pa.nulls(1, docs.type), pa.array([chunk], pa.int64()), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
             pa.nulls(1, pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays(
        [*empty, pa.array([pairs], long), pa.array([counts], long)], names=names)


def _sums(of_doc: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """Per document, in whole numbers."""
    ends = np.searchsorted(of_doc, np.arange(n), "right")
    return np.diff(np.concatenate([[0], np.cumsum(numbers)])[ends], prepend=0)


def pair_counts(held: DataFrame) -> DataFrame:
    """``(pair, n, best)``: links of each pair of ids in the corpus, and whether its id of B has none with more."""
    n = held.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).filter("x.counts > 0")
    n = n.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return n.withColumn("best", F.col("n") == F.max("n").over(of_b))


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per document."""
    held = alignments(docs, a_path, b_path, id_col, text_col)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    held = stored(held.withColumn("groups_sha256", digest).drop("groups"))
    counted = stored(pair_counts(held))
    places = held.filter("pairs IS NOT NULL").select(F.col("chunk").alias("home"), F.posexplode("pairs").alias("place", "pair"))
    places = places.join(counted, "pair").select("home", "place", "n", "best")
    told = held.filter("links IS NOT NULL").select(
        "chunk", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    schema = StructType([f for f in told.schema if f.name not in ("chunk", "links")]).add("n_best", LongType()).add("count_sum", LongType())

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        size = 1 + max(right["place"].to_pylist(), default=-1)
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = right["place"].to_numpy()
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy()
        links = [x.values.to_numpy() for x in left["links"]]
        out = left.drop_columns(["chunk", "links"])
        out = out.append_column("n_best", pa.array([int(best[x].sum()) for x in links], pa.int64()))
        return out.append_column("count_sum", pa.array([int(n[x].sum()) for x in links], pa.int64()))

    told = told.groupBy("chunk").cogroup(places.groupBy("home")).applyInArrow(add_up, schema)
    return told.select("doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def default_paths() -> tuple[str, str]:
    """The public files of A and B."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
