"""BM25 top-k over knowledge cards, by an inverted index built with joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure import dims
from exposure.functions.basics import lit_array, lit_map, settle

# Ranking constants.
K1, B = 1.5, 0.75
FLOOR, OWN_BOOST = 1.0, 50.0
PERSONAL = r"\b(?:my|mine|me|i|our)\b"


def card_text() -> Column:
    return F.concat_ws(" ", "title", "summary", "body", F.array_join("tags", " "))


def terms(text: Column) -> Column:
    """Words of three characters up, no stop words; synonyms follow, once per occurrence."""
    return with_synonyms(plain_words(text))


def plain_words(text: Column) -> Column:
    return F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z0-9]{3,}\b"), F.lit(0)),
        lambda w: ~w.isin(*dims.STOP_WORDS),
    )


def with_synonyms(words: Column) -> Column:
    synonyms = lit_map(dims.SYNONYMS)
    extra = F.transform(
        F.filter(words, lambda w: w.isin(*dims.SYNONYMS)),
        lambda w: F.try_element_at(synonyms, w),
    )
    return F.concat(words, F.coalesce(F.flatten(extra), lit_array([])))


def postings(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Term counts per document.  Counted in the explode's own shuffle, map side first."""
    worded = settle(docs.withColumn("_w", plain_words(F.col("_text"))), ["_w"])
    return (
        settle(worded.select(*keys, with_synonyms(F.col("_w")).alias("_t")), ["_t"])
        .withColumn("len", F.size("_t"))
        .select(*keys, "len", F.explode("_t").alias("term"))
        # stated here, as joins would add it for some readers only and split the exchange
        .filter(F.col("term").isNotNull())
        .groupBy(*keys, "len", "term")
        .agg(F.count("*").alias("tf"))
    )


def bm25_topk(
    questions: DataFrame, cards: DataFrame, own_cards: DataFrame | None = None, k: int = 3,
    qid: str = "qid", text: Column | None = None,
) -> DataFrame:
    """Best ``k`` cards of each question: ``qid, rank, id, score``.

    ``cards`` need ``id, ord`` and the text columns of :func:`card_text` (or pass
    ``text``).  ``own_cards`` carry ``device_id`` too: only questions of that device see
    them, they count in its statistics, and personal questions prefer them.
    """
    body = card_text() if text is None else text
    index = postings(cards.select("id", "ord", body.alias("_text")), ["id", "ord"])
    # every statistic reads the same postings, so the texts are tokenised once
    n_docs = cards.agg(F.count("*").alias("docs")).scalar()
    sum_len = index.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("len")).scalar()
    df_public = index.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    asked, wanted, own_index = question_terms(questions, own_cards, qid)
    weighted = weigh(wanted, df_public, n_docs, sum_len)
    scored = weighted.join(index, "term").groupBy("qid", "id", "ord").agg(F.sum(term_score()).alias("score"))
    return best(scored, own_scores(asked, weighted, own_cards, own_index), k)


def question_terms(
    questions: DataFrame, own_cards: DataFrame | None, qid: str
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The questions, a row per question and term with the statistics of own cards, and the postings of those."""
    device = F.col("device_id") if "device_id" in questions.columns else F.lit(None).cast("string")
    asked = questions.select(
        F.col(qid).alias("qid"), device.alias("device_id"), F.col("question"),
        F.lower("question").rlike(PERSONAL).alias("personal"),
    )
    wanted = (
        asked.select("qid", "device_id", F.explode(terms(F.col("question"))).alias("term"))
        .groupBy("qid", "device_id", "term")
        .agg(F.count("*").alias("qtf"))
    )
    if own_cards is None:
        zero = F.lit(None).cast("bigint")
        return asked, wanted.withColumns({"own_docs": zero, "own_len": zero, "own_df": zero}), None
    mine = own_cards.select("device_id", "id", "ord", card_text().alias("_text"))
    own_index = postings(mine, ["device_id", "id", "ord"])
    own_size = (
        mine.select("device_id", F.size(terms(F.col("_text"))).alias("len"))
        .groupBy("device_id").agg(F.count("*").alias("own_docs"), F.sum("len").alias("own_len"))
    )
    own_df = own_index.groupBy("device_id", "term").agg(F.count("*").alias("own_df"))
    return asked, wanted.join(own_size, "device_id", "left").join(own_df, ["device_id", "term"], "left"), own_index


def weigh(wanted: DataFrame, df_public: DataFrame, n_docs: Column, sum_len: Column) -> DataFrame:
    """``(qid, device_id, term, qtf, idf, avg_len)`` from the collection's statistics and the device's own."""
    nz = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = n_docs + nz("own_docs")
    df_all = nz("df") + nz("own_df")
    return wanted.join(df_public, "term", "left").select(
        "qid", "device_id", "term", "qtf",
        F.log((total - df_all + 0.5) / (df_all + 0.5) + 1.0).alias("idf"),
        ((sum_len + nz("own_len")) / total).alias("avg_len"),
    )


def term_score(tf: str = "tf", length: str = "len") -> Column:
    """What a term adds to a card; it grows with ``tf`` and falls with the card's length."""
    denom = F.col(tf) + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * (F.col(length) / F.col("avg_len")))
    return F.col("qtf") * F.col("idf") * (F.col(tf) * F.lit(K1 + 1.0) / denom)


def own_scores(
    asked: DataFrame, weighted: DataFrame, own_cards: DataFrame | None, own_index: DataFrame | None
) -> DataFrame | None:
    """Scores of a device's own cards, boosted for personal questions.

    A boosted card may share no word with the question; without any word at all nothing is answered.
    """
    if own_cards is None:
        return None
    own = weighted.join(own_index, ["device_id", "term"]).groupBy("qid", "id", "ord").agg(F.sum(term_score()).alias("score"))
    boosted = (
        asked.filter(F.col("personal"))
        .join(weighted.select("qid").distinct(), "qid", "left_semi")
        .join(own_cards.select("device_id", "id", "ord"), "device_id")
        .select("qid", "id", "ord", F.lit(OWN_BOOST).alias("score"))
    )
    return own.unionByName(boosted).groupBy("qid", "id", "ord").agg(F.sum("score").alias("score"))


def best(scored: DataFrame, own: DataFrame | None, k: int) -> DataFrame:
    """The best ``k`` above the floor; own cards go first among equals."""
    scored = scored.withColumn("own", F.lit(1))
    if own is not None:
        scored = scored.unionByName(own.withColumn("own", F.lit(0)))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "own", "ord")
    return (
        scored.filter(F.col("score") >= FLOOR)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("qid", "rank", "id", "score")
    )


def posture_cards(told: DataFrame) -> DataFrame:
    """Each device's own cards, from its scores and its lever."""
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    best = F.col("best")
    projected = F.col("overall") + best["points"]
    score = F.struct(
        F.lit("user_posture_summary").alias("id"), F.lit(0).alias("ord"),
        say("Your risk score (", F.col("overall"), "/100)").alias("title"),
        lit_array(["posture", "user", "score", "drivers", "lever", "low", "arithmetic"]).alias("tags"),
        F.col("story").alias("summary"),
        say(
            "Overall security score ", F.col("overall"), "/100, ", F.col("risk_level"), " risk. Privacy ",
            F.col("privacy"), "/100. Browsing ", F.col("browsing"), "/100.",
        ).alias("body"),
    )
    lever = F.when(best.isNotNull(), F.struct(
        F.lit("user_biggest_lever").alias("id"), F.lit(1).alias("ord"),
        F.lit("Top security recommendation").alias("title"),
        lit_array(["posture", "recommendation", "lever", "action", "fix"]).alias("tags"),
        best["todo"].alias("summary"),
        say(
            "Action: ", best["todo"], " Score now ", F.col("overall"), ", then ", projected, " (+",
            best["points"], ").",
        ).alias("body"),
    ))
    rows = F.filter(F.array(score, lever), lambda c: c.isNotNull())
    return told.select("device_id", F.inline(rows))


def answers(questions: DataFrame, ranked: DataFrame, cards: DataFrame, own_cards: DataFrame | None = None, qid: str = "qid") -> DataFrame:
    """The best card's text as the answer; ``answered`` is false and the answer NULL without one."""
    device = F.col("device_id") if "device_id" in questions.columns else F.lit(None).cast("string")
    per_q = ranked.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("_r"),
    ).select("qid", F.transform("_r", lambda x: x["id"]).alias("sources"))
    q = (
        questions.select(F.col(qid).alias("qid"), device.alias("device_id"), "question")
        .join(per_q, "qid", "left")
        .withColumn("top", F.get("sources", F.lit(0)))
    )
    text = F.concat(F.col("summary"), F.lit("\n\n"), F.col("body"))
    q = q.join(cards.select(F.col("id").alias("top"), text.alias("_public")), "top", "left")
    if own_cards is not None:
        q = q.join(own_cards.select("device_id", F.col("id").alias("top"), text.alias("_own")), ["device_id", "top"], "left")
    else:
        q = q.withColumn("_own", F.lit(None).cast("string"))
    return q.select(
        "qid", "question", F.col("top").isNotNull().alias("answered"),
        F.coalesce("_own", "_public").alias("answer"), "sources",
        F.coalesce(F.exists("sources", lambda s: F.startswith(s, F.lit("user_"))), F.lit(False)).alias("personal_context_used"),
    )
