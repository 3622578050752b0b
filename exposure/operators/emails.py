"""Score emails: where links lead, what the words ask for, who sent it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure import dims
from exposure.functions import hosts
from exposure.functions.basics import compact, excerpt, first, half_up, hits_type, pick, py_strip, settle
from exposure.operators import evidence as ev

# Group weights, gate and the parts of an address.
W_LINKS, W_CONTENT, W_SENDER = 0.35, 0.30, 0.15
MIN_CHARS = 40
ADDRESS = r"""(?U)^\s*(?:"?([^"<]*?)"?\s*)?<?([^<>\s@]+@[^<>\s@]+?)>?\s*$"""

ADVICE = {
    "dangerous": "Click nothing, open nothing, do not answer, and ask the company through its own app.",
    "suspicious": "Not proven genuine: reach the company the way you usually do before acting.",
    "safe": "Nothing was found, which is no guarantee: never type secrets on a page opened from a link.",
    "unknown": "Too little to judge: give the whole message with its sender line.",
}
ACTIONS = (
    ("credential_request", "If you typed a secret because of this, change it now in the official app."),
    ("unusual_payment", "If you paid, call your bank at once."),
    ("attachment_lure", "If you opened the file, go offline and scan the device."),
    ("link_display_mismatch", "If you entered anything after the click, change that password."),
    ("link_brand_mismatch", "If you entered anything after the click, change that password."),
)


def parse_sender(raw: Column) -> Column:
    """``struct<display,address,domain>``, NULL if the line cannot be read."""
    text = py_strip(raw)
    address = F.lower(F.regexp_extract(text, ADDRESS, 2))
    domain = hosts.registrable(F.substring_index(address, "@", -1))
    ok = text.rlike(ADDRESS) & F.contains(domain, F.lit("."))
    return F.when(
        ok,
        F.struct(
            F.trim(F.regexp_extract(text, ADDRESS, 1)).alias("display"),
            address.alias("address"),
            domain.alias("domain"),
        ),
    )


def _brands_in(text: Column) -> Column:
    return F.filter(hosts.host_tokens(text), hosts.is_brand)


def add_sender_hits(df: DataFrame, sender: str, reply_to: str, subject: str) -> DataFrame:
    """Add ``sender`` group columns; ``sender_hits`` is NULL where nobody is named."""
    df = df.withColumn("_from", parse_sender(F.col(sender))).withColumn("_reply", parse_sender(F.col(reply_to)))
    f, r = F.col("_from"), F.col("_reply")
    host = F.substring_index(f["address"], "@", -1)
    df = df.withColumn("_brand", F.when(hosts.brand_suspected(host), hosts.check_brand(host)))
    brand, domain = F.col("_brand"), f["domain"]
    local = F.substring_index(f["address"], "@", 1)
    claimed = first(F.filter(
        _brands_in(F.concat_ws(" ", f["display"], local)),
        lambda t: ~hosts.owns(t, domain),
    ))
    authority = first(_brands_in(F.concat_ws(" ", f["display"], F.coalesce(F.col(subject), F.lit("")))))
    hits = compact(
        F.when(hosts.mismatch(brand), ev.hit(
            "sender_lookalike_domain", F.when(brand["kind"] == "lookalike", 95).otherwise(85),
            F.concat(F.lit("Sent from "), domain, F.lit(", which is not "), brand["brand"], F.lit(".")), f["address"],
        )).when(claimed.isNotNull(), ev.hit(
            "sender_brand_mismatch", 90,
            F.concat(F.lit("Signs as "), claimed, F.lit(" but was sent from "), domain, F.lit(".")),
            excerpt(F.col(sender)),
        )),
        F.when(domain.isin(dims.FREEMAIL) & authority.isNotNull(), ev.hit(
            "sender_freemail_authority", 75,
            F.concat(F.lit("Speaks for "), authority, F.lit(" from a free "), domain, F.lit(" mailbox.")), f["address"],
        )),
        F.when(r.isNotNull() & (r["domain"] != domain), ev.hit(
            "sender_reply_to_mismatch", 70,
            F.concat(F.lit("Answers go to "), r["domain"], F.lit(", not to "), domain, F.lit(".")), r["address"],
        )),
    )
    return (
        df.withColumn("sender_domain", domain)
        .withColumn("sender_hits", F.when(f.isNotNull(), hits.cast(hits_type())))
        .drop("_from", "_reply", "_brand")
    )


def email_groups(
    emails: DataFrame, sender: str = "sender", reply_to: str = "reply_to",
    subject: str = "subject", body: str = "body",
) -> DataFrame:
    """Add links, visible text and the hits of the three groups."""
    whole = F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit("\n"), F.coalesce(F.col(body), F.lit("")))
    df = emails.withColumn("visible", ev.strip_markup(whole))
    df = ev.add_link_hits(ev.add_links(df, body))
    df = ev.add_content_hits(df, "visible")
    df = add_sender_hits(df, sender, reply_to, subject)
    return settle(df, ["visible", "links", "link_hits", "content_hits", "sender_domain", "sender_hits"])


def score_emails(emails: DataFrame, intents: DataFrame | None = None, id_col: str = "msg_id", **cols) -> DataFrame:
    """Score, verdict, confidence, signals and advice of each email; nothing is dropped."""
    df = email_groups(emails, **cols)
    if intents is None:
        none = lambda t: F.lit(None).cast(t)
        df = df.withColumns({
            "intent": none("string"), "intent_label": none("string"), "intent_penalty": none("int"),
            "intent_rationale": none("string"), "intent_quotes": none("array<string>"),
        })
    else:
        df = df.join(ev.valid_intents(intents, dims.EMAIL_INTENTS, id_col), id_col, "left")
    known = F.col("sender_hits").isNotNull()
    df = (
        df.withColumn("link_penalty", ev.group_penalty(F.col("link_hits"), ev.LINK_BUMP))
        .withColumn("content_penalty", ev.group_penalty(F.col("content_hits"), ev.CONTENT_BUMP))
        .withColumn("sender_penalty", F.when(known, ev.group_penalty(F.col("sender_hits"), ev.SENDER_BUMP)))
    )
    weighted = (
        F.lit(W_LINKS) * F.col("link_penalty")
        + F.lit(W_CONTENT) * F.col("content_penalty")
        + F.when(known, F.lit(W_SENDER) * F.col("sender_penalty")).otherwise(0.0)
    )
    available = F.lit(W_LINKS) + F.lit(W_CONTENT) + F.when(known, W_SENDER).otherwise(0.0)
    enough = F.length(py_strip(F.col("visible"))) >= MIN_CHARS
    score = F.when(enough, F.least(F.lit(100), half_up(ev.raise_only(weighted / available)))).otherwise(0)
    df = df.withColumn("risk_score", score.cast("int")).withColumn(
        "verdict", F.when(enough, ev.verdict_of(F.col("risk_score"))).otherwise("unknown")
    )
    all_hits = F.concat("link_hits", "content_hits", F.coalesce("sender_hits", ev.no_hits()))
    n_hits = F.size(all_hits)
    answered = F.col("intent").isNotNull()
    n_links = F.size("links")
    intent_row = F.array(F.struct(
        F.when(answered, F.concat(F.lit("intent_"), F.col("intent"))).otherwise("intent_missing").alias("signal"),
        F.when(answered, F.coalesce("intent_rationale", "intent_label")).otherwise("The intent was not read.").alias("detail"),
        F.when(~answered, "unknown").when(F.col("intent") == "benign", "good").otherwise("bad").alias("weight"),
        F.when(answered, ev.quote_in(F.col("visible"))).alias("evidence"),
    ).cast(ev.SIGNAL))
    signals = F.concat(
        ev.group_signals(
            F.col("link_hits"), F.lit(True), "links_clean",
            F.when(n_links == 0, "No web links.").otherwise(F.concat(n_links.cast("string"), F.lit(" links lead where they say."))),
            "links_missing", "",
        ),
        ev.group_signals(F.col("content_hits"), F.lit(True), "wording_clean", "The wording puts on no pressure.", "wording_missing", ""),
        ev.group_signals(
            F.coalesce("sender_hits", ev.no_hits()), known, "sender_clean", "The sender fits its claim.",
            "sender_missing", "No sender line was given.",
        ),
        intent_row,
    )
    short = F.array(F.struct(
        F.lit("insufficient_text").alias("signal"), F.lit("Too little readable text.").alias("detail"),
        F.lit("unknown").alias("weight"), F.lit(None).cast("string").alias("evidence"),
    ).cast(ev.SIGNAL))
    return (
        df.withColumn("n_hits", F.when(enough, n_hits).otherwise(0))
        .withColumn(
            "confidence",
            F.when(enough, ev.ladder(n_hits, known, answered, F.col("verdict"), 0.80)).otherwise(0.0),
        )
        .withColumn("signals", F.when(enough, ev.in_severity_order(signals)).otherwise(short))
        .withColumn(
            "recommendation",
            F.concat_ws(" ", F.when(enough, ev.first_advice(all_hits, ACTIONS)), pick(ADVICE, F.col("verdict"))),
        )
        .withColumn("heuristics_only", ~(answered & enough))
    )
