"""Mixing sources to target weights as a time-varying curriculum.

* Targets.  Sources, in order of their names by code point with NULL last, weigh 5, 2, 1 and
  again so.  They share ``budget`` times all words by weight; a target stops at ``most`` times
  its source's size and the excess is shared again by weight until none is above.  That is
  the level L with sum(min(L * weight, cap)) = budget, found by sorting sources by cap per weight.
* Stream.  The documents of a source, in the order of a hash, repeat until the target is met;
  the copy that crosses it is taken in part, so every source meets its target to one word.
* Positions.  Each class of weights has a schedule, a piecewise linear weight over training
  time 0 to 1.  Its integral, scaled to the target, is the source's cumulative demand for
  words; the inverse of that at a copy's middle word is the copy's training position.
  Copies are then range-sorted by position.

A source may hold most rows: running sums go by source and hash bucket, and only the bucket
totals meet per source.  Sources are a small table (one row each), sorted in one task.

A NULL text and a text without words have size 0 and are taken 0 times.  A NULL source is a
source.  Repeated rows are documents of their own; which of two alike comes first does not
matter.  No rows give no rows.  Extra columns are ignored or, in ``mixed``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: hexadecimal digits of the hash: 4096 buckets of a source
BUCKET_DIGITS = 3
#: per class of weights, weight at equal steps of time: large sources first, small ones last
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def training_time(share: Column, schedule: tuple[float, ...]) -> Column:
    """When a source has been given this share of its words: the inverse of the integral."""
    step = 1.0 / (len(schedule) - 1)
    areas = [step * (a + b) / 2 for a, b in zip(schedule, schedule[1:])]
    total, before, out = sum(areas), 0.0, None
    for k, area in enumerate(areas):
        a, b = schedule[k] / total, schedule[k + 1] / total
        x = F.greatest(share - before, F.lit(0.0))
        slope = (b - a) / step
        inside = x / a if slope == 0 else (F.sqrt(F.greatest(a * a + 2 * slope * x, F.lit(0.0))) - a) / slope
        before += area / total
        at = F.least(F.lit(k * step) + inside, F.lit((k + 1) * step))
        if k == len(areas) - 1:
            return at if out is None else out.otherwise(at)
        out = F.when(share < before, at) if out is None else out.when(share < before, at)
    raise ValueError("a schedule needs two weights at least")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(source_col).cast("string")
    return stored(docs.select(
        F.col(id_col).alias("doc"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(id_col, text_col).alias("h"),
        F.left(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))), F.lit(16)).alias("turn"),
    ))


def source_targets(sized: DataFrame, budget: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, class, source_size, target)``, one row per source (``n``: NULL, else ``s`` and its name)."""
    every = Window.orderBy(F.col("source") == "n", "source")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", (F.row_number().over(every) - 1).alias("rank")
    )
    sums = sums.withColumn("class", F.col("rank") % len(weights))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("class") + 1)
    sums = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(budget) - F.coalesce(F.sum("cap").over(below), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    levels = sums.withColumn("level", left / open_weight)
    met = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)
    target = F.least(met["level"] * F.col("weight"), F.col("cap").cast("double"))
    return levels.select("source", "class", "source_size", target.alias("target"))


def placements(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    budget: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES,
) -> DataFrame:
    """Per input row ``(doc, h, size, source_size, target, taken, copies)``.

    ``copies`` lists ``(pass, taken, position)`` of each copy that the mix takes.
    """
    sized = _sized(docs, id_col, text_col, source_col).withColumn("bucket", F.left("turn", F.lit(BUCKET_DIGITS)))
    targets = source_targets(sized, budget, most, weights)
    in_bucket = Window.partitionBy("source", "bucket").orderBy("turn", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    over_buckets = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select(
        "source", "bucket", F.coalesce(F.sum("words").over(over_buckets), none).alias("reached")
    )
    placed = (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), none))
        .join(buckets, ["source", "bucket"]).join(targets, "source")
    )
    start = F.col("reached") + F.col("inside")
    wanted = F.round("target").cast("long")

    def copy(k: Column) -> Column:
        begin = start + k * F.col("source_size")
        taken = F.greatest(F.least(F.col("size"), wanted - begin), none)
        share = (begin + taken / 2) / F.greatest(F.col("target"), F.lit(1.0))
        by_class = None
        for c, schedule in enumerate(schedules):
            at = training_time(share, schedule)
            by_class = F.when(F.col("class") == c, at) if by_class is None else by_class.when(F.col("class") == c, at)
        return F.struct(k.cast("int").alias("pass"), taken.alias("taken"), by_class.alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), copy), lambda c: c["taken"] > 0)
    taken = F.aggregate("copies", none, lambda acc, c: acc + c["taken"])
    return placed.withColumn("copies", copies).select(
        "doc", "h", "size", "source_size", "target", taken.alias("taken"), "copies"
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: a row per copy in training order, with ``copy_pass``, ``taken_words`` and ``position`` added.

    The copy that crosses its source's target holds its first ``taken_words`` words.
    """
    alike = Window.partitionBy("h").orderBy("doc", "size")
    copies = placements(docs, id_col, text_col, source_col, **how).filter("taken > 0").select(
        F.col("h").alias("h_"), F.row_number().over(alike).alias("n_"), "size", "copies"
    ).select("h_", "n_", "size", F.explode("copies").alias("c"))
    added = {"copy_pass": F.col("c.pass"), "taken_words": F.col("c.taken"), "position": F.col("c.position")}
    keep = [c for c in docs.columns if c not in added]
    own = docs.select(F.struct(*keep).alias("row_"), F.xxhash64(id_col, text_col).alias("h_"))
    own = own.withColumn("nth_", F.row_number().over(Window.partitionBy("h_").orderBy(F.col("row_")[id_col])))
    # rows repeated whole are told apart by number, in a condition that leaves the text where the window put it;
    # both sides lie by hash already, and Spark would size the copies as they were before the explode
    out = own.join(copies.hint("merge"), (own["h_"] == copies["h_"]) & (own["nth_"] - copies["n_"] == 0))
    text = F.col("row_")[text_col]
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    first = F.array_join(F.slice(words, F.lit(1), F.col("c.taken").cast("int")), " ")
    text = F.when(F.col("c.taken") < F.col("size"), first).otherwise(text)
    kept = [(text if c == text_col else F.col("row_")[c]).alias(c) for c in keep]
    return out.select(*kept, *[v.alias(k) for k, v in added.items()]).orderBy("position", id_col)
