"""Line dedup by a deletion-neighbourhood join.

A line is dropped if an earlier line, by id and then by place, equals it or is at most one
edit of one character away.  Lines are compared without blanks at their ends; a line of fewer
than ``min_chars`` characters is left alone, and so are blank ones.

Two lines within one edit share a deletion variant: if one character was replaced, both give
the same text without it; if one was added, the longer gives the shorter.  Emitting every
variant of every line would multiply the corpus by its line length, so the neighbourhood is
narrowed first, without loss:

1. Equal lines collapse to their first place.
2. Cut into pieces, two lines within one edit agree on all but one piece, counted from the left
   before it and from the right after it.  Lines travel as hashes of what is left when one of
   2 pieces is deleted; lines that share no such hash have no neighbour.
3. What remains does the same with 16 pieces, and then with every single character: these are
   the deletion variants.  A variant's key says which character was deleted, so lines of one
   key differ by exactly that character and the earliest one drops the others; no pairs are made.
4. The edit distance of each dropped line to the line that drops it is verified.

Rows repeated whole (id and text) are one document and lose the same lines.  A NULL or empty
text has no lines.  Rows with a NULL id come last.  Extra columns are kept by
``without_repeated_lines`` and ignored elsewhere.  No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm import words as W
from exposure.llm.shared import stored

MIN_CHARS = 20
BLANKS = " \t\x0b\x0c\r"


def _piece_key(text: Column, pieces: int, k: Column) -> Column:
    """Hash of a line without one of its pieces, cut by its own length (first ``pieces`` values of ``k``) or by one less.

    A line and one with a character more are both cut by the shorter length.
    """
    base, i = F.length(text) - F.floor(k / pieces).cast("int"), k % pieces
    cut, after = F.floor(base * i / pieces).cast("int"), F.floor(base * (i + 1) / pieces).cast("int")
    return F.xxhash64(base, i, F.left(text, cut), F.right(text, base - after))


def _piece_keys(lines: DataFrame, pieces: int) -> DataFrame:
    """``(h, key)``: all such hashes of each line."""
    dealt = lines.select("h", "text", F.explode(F.sequence(F.lit(0), F.lit(2 * pieces - 1))).alias("k"))
    return dealt.select("h", _piece_key(F.col("text"), pieces, F.col("k")).alias("key"))


def _with_company(keyed: DataFrame) -> DataFrame:
    """Lines ``h`` of which another line shares a key."""
    shared = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high")
    return keyed.join(shared, "key", "left_semi").select("h").distinct()


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = docs.select(
        F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("doc"),
        F.posexplode(F.split(text_col, "\n")).alias("line", "raw"),
    )
    return rows.select("row", "doc", "line", F.btrim("raw", F.lit(BLANKS)).alias("text")).filter(F.length("text") >= min_chars)


def _variants(batches):
    """``(key, h, first, role)``: deletion variants of lines, hashed in linear time."""
    for batch in batches:
        for i, text in enumerate(batch["text"].to_pylist()):
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
            n = len(chars)
            held = W.mix(chars + np.uint64(1)) * W.powers(W.BASE, n)
            before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(held, dtype=np.uint64)])
            rest = before[:n] + (before[n] - before[1:]) * W.INVERSE
            size = np.uint64(n)
            swapped = W.mix(W.mix(rest + size) + np.arange(n, dtype=np.uint64) + np.uint64(1))
            longer = np.unique(W.mix(rest + size - np.uint64(1)))
            shorter = W.mix(before[n:] + size)
            keys = np.concatenate([swapped, longer, shorter]).view(np.int64)
            role = np.concatenate([np.zeros(n, np.int8), np.full(len(longer), 1, np.int8), [2]]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys), pa.array(np.full(len(keys), batch["h"][i].as_py())),
                batch["first"].take(pa.array(np.full(len(keys), i))), pa.array(role),
            ], names=["key", "h", "first", "role"])


def _neighbours(lines: DataFrame, first: DataFrame) -> DataFrame:
    """``(h, earlier)``: lines within one edit of an earlier line ``earlier``, the earliest per key."""
    coarse = first.select("h", F.explode("keys").alias("key"))
    some = stored(
        first.select("h", "first").join(_with_company(coarse), "h", "left_semi")
        .join(lines.select("row", "line", F.col("h").alias("same"), "text"),
              (F.col("first.row") == F.col("row")) & (F.col("first.line") == F.col("line")) & (F.col("h") == F.col("same")))
        .select("h", "first", "text")
    )
    some = stored(some.join(_with_company(_piece_keys(some, 16)), "h", "left_semi"))
    order = "struct<unnamed:boolean,doc:{},row:bigint,line:int>".format(
        dict(some.select("first.doc").dtypes)["doc"])
    variants = some.select("h", "first", "text").mapInArrow(_variants, f"key long, h long, first {order}, role byte")
    earliest = variants.groupBy("key").agg(
        *[F.min(F.when(F.col("role") == r, F.struct("first", "h"))).alias(f"of_{r}") for r in range(3)]
    )
    # Spark sizes variants as the lines they come from, a hundredth of their own size, and would broadcast them
    met = variants.hint("merge").join(earliest, "key")
    other = F.when(F.col("role") == 0, F.col("of_0")).when(F.col("role") == 1, F.col("of_2")).otherwise(F.col("of_1"))
    met = met.select("h", "first", other.alias("other")).filter("other.first < first")
    pairs = met.select("h", F.col("other.h").alias("earlier")).distinct()
    one, two = some.select("h", "text"), some.select(F.col("h").alias("earlier"), F.col("text").alias("text_2"))
    return pairs.join(one, "h").join(two, "earlier").filter(F.levenshtein("text", "text_2", 1) >= 0).select("h", "earlier")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(row, lines)``: per document (``row`` = xxhash64 of id and text) the places of lines to drop."""
    lines = _lines(docs, id_col, text_col, min_chars).withColumn("h", F.xxhash64("text"))
    place = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "row", "line")
    # one pass over the texts gives a narrow row per distinct line, with its keys of two pieces
    keys = F.array_distinct(F.array(*[_piece_key(F.col("text"), 2, F.lit(k)) for k in range(4)]))
    first = stored(lines.withColumn("keys", keys).groupBy("h").agg(
        F.min(place).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    near = stored(_neighbours(lines, first.select("h", "first", "keys")).select("h").distinct())
    marked = first.select("h", "first", "n").join(near.withColumn("near", F.lit(True)), "h", "left").filter("n > 1 OR near")
    dropped = lines.select("h", place.alias("place")).join(marked, "h").filter("near OR place > first")
    return dropped.groupBy("place.row").agg(F.collect_set("place.line").alias("lines"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All input rows and columns, the text without dropped lines, and ``n_lines`` and ``n_dropped``."""
    gone = repeated_lines(docs, id_col, text_col, min_chars).withColumnRenamed("row", "row_")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = docs.select(F.struct(*keep).alias("all_"), F.xxhash64(id_col, text_col).alias("row_"))
    joined = own.join(gone, "row_", "left").select("all_", "lines")
    schema = joined.select("all_.*").schema.add("n_lines", "long").add("n_dropped", "long")

    def cut(batches):
        for batch in batches:
            table = pa.Table.from_struct_array(batch["all_"])
            texts, counts, drops = [], [], []
            for text, lines in zip(table[text_col].to_pylist(), batch["lines"].to_pylist()):
                parts = text.split("\n") if text is not None else []
                counts.append(len(parts) if text else 0)
                drops.append(len(lines or ()))
                if lines:
                    gone = set(lines)
                    text = "\n".join(x for i, x in enumerate(parts) if i not in gone)
                texts.append(text)
            at = table.schema.get_field_index(text_col)
            table = table.set_column(at, table.schema.field(at), pa.array(texts, table.schema.field(at).type))
            table = table.append_column("n_lines", pa.array(counts, pa.int64()))
            yield from table.append_column("n_dropped", pa.array(drops, pa.int64())).to_batches()

    return joined.mapInArrow(cut, schema)
