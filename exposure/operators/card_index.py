"""BM25 top-k over a stored index, for collections that many batches of questions are asked of.

A term's postings are dealt into levels of like weight.  A block is a term's postings of one level;
the small table of blocks holds how many there are and the extremes of their counts and lengths,
from which follow, for any question, the least and the most that a posting of the block can add.

* The threshold of a question is read from the blocks alone: the blocks that add most, taken until
  they hold ``k`` cards, prove that the k-th best card scores no less than the least of them.
* A block is opened only if its most, plus the most of all other terms, reaches the threshold.
* Candidates come from essential terms alone.  The terms of least weight, which together stay
  below the threshold, find no card by themselves, so frequent words are looked up for candidates only.
* Where the blocks say that these look-ups outnumber the postings of the questions' terms, the postings are summed
  in one pass instead, and candidates kept.

Results are those of :func:`exposure.operators.retrieval.bm25_topk`, ties and own cards included.
The index is bucketed by term and part, a hash of the card, so a frequent term lies in many buckets;
all joins carry these two columns and move the questions' side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposure.operators import retrieval
from exposure.operators.retrieval import FLOOR, K1, B

#: levels of a term, by what tf and length make of its weight
LEVELS = 64
#: sums of the same numbers in another order differ by far less
SLACK = 1e-6


@dataclass(frozen=True)
class CardIndex:
    """``postings(term, part, level, id, ord, tf, len)``, ``blocks`` and one row of ``sizes``."""

    postings: DataFrame
    blocks: DataFrame
    sizes: DataFrame
    parts: int


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("id", "ord"), F.lit(parts)).cast("int")


def write_index(cards: DataFrame, name: str, text: Column | None = None, parts: int = 16, buckets: int = 64) -> None:
    """Tables ``<name>_postings``, ``<name>_blocks`` and ``<name>_sizes`` of cards as ``bm25_topk`` takes them.

    Each bucket is one sorted file; take more buckets and parts for more cards.
    """
    spark = cards.sparkSession
    body = retrieval.card_text() if text is None else text
    found = retrieval.postings(cards.select("id", "ord", body.alias("_text")), ["id", "ord"])
    mean = found.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("len")).scalar() / cards.agg(F.count("*")).scalar()
    share = F.col("tf") / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / mean))
    leveled = found.select(
        "term", _part(parts).alias("part"), F.floor(share * LEVELS).cast("int").alias("level"), "id", "ord", "tf", "len"
    )
    (
        leveled.repartition(buckets, "term", "part").sortWithinPartitions("term", "part", "level")
        .write.bucketBy(buckets, "term", "part").sortBy("term", "part", "level").mode("overwrite")
        .saveAsTable(f"{name}_postings")
    )
    stored = spark.table(f"{name}_postings")
    stored.groupBy("term", "level").agg(
        F.count("*").alias("docs"), F.min("tf").alias("tf_low"), F.max("tf").alias("tf_high"),
        F.min("len").alias("len_low"), F.max("len").alias("len_high"),
    ).write.mode("overwrite").saveAsTable(f"{name}_blocks")
    sizes = cards.agg(F.count("*").alias("docs")).crossJoin(  # one row by one row
        stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("len"))
    )
    sizes.select("docs", "len", F.lit(parts).alias("parts")).write.mode("overwrite").saveAsTable(f"{name}_sizes")


def read_index(spark: SparkSession, name: str) -> CardIndex:
    """An index as written above.

    Sets ``spark.sql.requireAllClusterKeysForCoPartition`` to false for the session: without it joins
    on more columns than term and part would move the postings.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    sizes = spark.table(f"{name}_sizes")
    return CardIndex(spark.table(f"{name}_postings"), spark.table(f"{name}_blocks"), sizes, sizes.first()["parts"])


def _weighted(wanted: DataFrame, index: CardIndex) -> DataFrame:
    df = index.blocks.groupBy("term").agg(F.sum("docs").alias("df"))
    return retrieval.weigh(
        wanted, df, index.sizes.select("docs").scalar(), index.sizes.select("len").scalar()
    )


def opened_blocks(weighted: DataFrame, index: CardIndex, k: int = 3) -> DataFrame:
    """``(qid, term, level, docs, essential)``: the blocks that can hold one of the best ``k``."""
    bounded = weighted.join(index.blocks, "term").select(
        "qid", "term", "level", "docs",
        retrieval.term_score("tf_low", "len_high").alias("low"),
        retrieval.term_score("tf_high", "len_low").alias("high"),
    )
    # at most LEVELS rows of a term of a question
    downwards = Window.partitionBy("qid", "term").orderBy(F.desc("low"), "level").rowsBetween(Window.unboundedPreceding, 0)
    counted = bounded.withColumn("held", F.sum("docs").over(downwards))
    per_term = counted.groupBy("qid", "term").agg(
        F.max("high").alias("top"), F.max(F.when(F.col("held") >= k, F.col("low"))).alias("sure")
    )
    per_question = Window.partitionBy("qid")
    weakest_first = per_question.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)
    judged = per_term.select(
        "qid", "term",
        (F.greatest(F.lit(FLOOR), F.coalesce(F.max("sure").over(per_question), F.lit(FLOOR))) - SLACK).alias("threshold"),
        (F.sum("top").over(per_question) - F.col("top")).alias("others"),
        F.sum("top").over(weakest_first).alias("reach"),
    )
    return (
        bounded.join(judged, ["qid", "term"])
        .filter(F.col("high") + F.col("others") >= F.col("threshold"))
        .select("qid", "term", "level", "docs", (F.col("reach") >= F.col("threshold")).alias("essential"))
    )


def _many_candidates(weighted: DataFrame, opened: DataFrame, index: CardIndex) -> bool:
    """Whether candidates times terms, as the blocks bound them, exceed all postings of the questions' terms."""
    terms = weighted.groupBy("qid").agg(F.count("*").alias("terms"))
    lookups = opened.groupBy("qid").agg(F.sum("docs").alias("docs")).join(terms, "qid").agg(F.sum(F.col("docs") * F.col("terms"))).first()[0]
    return (lookups or 0) > (weighted.select("term").join(index.blocks, "term").agg(F.sum("docs")).first()[0] or 0)


def _looked_up(weighted: DataFrame, opened: DataFrame, index: CardIndex) -> DataFrame:
    """Scores of the cards in opened blocks: each is sent to the terms of its question."""
    every_part = F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1))).alias("part")
    found = (
        opened.select("qid", "term", "level", every_part).repartition("term", "part")
        .join(index.postings, ["term", "part", "level"])
        .select("qid", "id", "ord").distinct()
    )
    probes = found.join(weighted, "qid").withColumn("part", _part(index.parts)).repartition("term", "part")
    return (
        probes.join(index.postings.drop("level"), ["term", "part", "id", "ord"])
        .groupBy("qid", "id", "ord").agg(F.sum(retrieval.term_score()).alias("score"))
    )


def _one_pass(weighted: DataFrame, opened: DataFrame, index: CardIndex) -> DataFrame:
    """The same scores, summed over all postings of the questions' terms; what lies in no opened block is dropped after."""
    levels = opened.groupBy("qid", "term").agg(F.collect_set("level").alias("levels"))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1)))
    probes = weighted.join(levels, ["qid", "term"], "left").withColumn("part", every_part).repartition("term", "part")
    named = index.postings.filter(F.col("id").isNotNull() & F.col("ord").isNotNull())
    return (
        probes.join(named, ["term", "part"])
        .withColumn("candidate", F.coalesce(F.array_contains("levels", F.col("level")), F.lit(False)))
        .groupBy("qid", "id", "ord").agg(F.sum(retrieval.term_score()).alias("score"), F.max("candidate").alias("candidate"))
        .filter("candidate").drop("candidate")
    )


def topk(
    questions: DataFrame, index: CardIndex, own_cards: DataFrame | None = None, k: int = 3, qid: str = "qid"
) -> DataFrame:
    """Best ``k`` cards of each question: ``qid, rank, id, score``, as ``bm25_topk`` gives them."""
    asked, wanted, own_index = retrieval.question_terms(questions, own_cards, qid)
    weighted = _weighted(wanted, index)
    opened = opened_blocks(weighted, index, k).filter("essential")
    score = _one_pass if _many_candidates(weighted, opened, index) else _looked_up
    scored = score(weighted, opened, index)
    return retrieval.best(scored, retrieval.own_scores(asked, weighted, own_cards, own_index), k)
