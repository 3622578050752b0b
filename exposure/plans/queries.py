"""The registered queries: one callable ``(spark, folder) -> DataFrame`` per operator or report.

Results are flat (strings, bigints, doubles, booleans); times are in microseconds.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exposure.functions import hosts
from exposure.functions.basics import settle
from exposure.operators import (
    card_index, conversations, dashboard, day_sums, destinations, emails, evidence, identity, narrative, payloads, pii,
    retrieval, reviews, risk, urls,
)
from exposure.plans import derive
from exposure.sources import corpora, tables
from exposure.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return flat(fn(spark, sf))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def flat(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder; local only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return os.path.join(shared or tempfile.mkdtemp(prefix="exposure-"), uuid.uuid4().hex)


def _device_tables(spark, sf):
    return derive.pii_events(spark, sf), derive.site_checks(spark, sf), derive.identity_checks(spark, sf)


def _scored(spark, sf):
    return risk.add_scores(risk.device_totals(*_device_tables(spark, sf), derive.now()))


def _told(spark, sf):
    return narrative.narrative(_scored(spark, sf), identity.live_checks(derive.identity_checks(spark, sf)))


# --- device risk ----------------------------------------------------------


@query
def risk_overall(spark, sf):
    """K1-K7, K9, K11, I5, I6"""
    return risk.risk_scores(*_device_tables(spark, sf), derive.now())


@query
def risk_contributions(spark, sf):
    """K8, I8"""
    return risk.contributions(_scored(spark, sf)).drop("detail")


@query
def risk_recommendations(spark, sf):
    """K10, I7"""
    return risk.recommendations(_scored(spark, sf)).drop("title", "detail")


@query
def risk_contribution_details(spark, sf):
    """K8, I8: what each part of the score rests on, in words"""
    return risk.contributions(_scored(spark, sf)).select("device_id", "component", "detail")


@query
def risk_recommendation_texts(spark, sf):
    """Title and detail of each piece of advice"""
    return risk.recommendations(_scored(spark, sf)).select("device_id", "rank", "title", "detail")


@query
def risk_stories(spark, sf):
    """The story of each score"""
    return _told(spark, sf).select("device_id", "story")


@query
def risk_drivers(spark, sf):
    """N1-N6"""
    return narrative.drivers(_told(spark, sf)).drop("sentence")


@query
def risk_causes(spark, sf):
    """All causes, every breached password among them"""
    live = identity.live_checks(derive.identity_checks(spark, sf))
    return narrative.cause_rows(_scored(spark, sf), live).select(
        "device_id", "key", "code", "points", "severity", "subjects", "action"
    )


@query
def risk_lever(spark, sf):
    """N7, N8"""
    return narrative.levers(_told(spark, sf)).drop("sentence", "story")


@query
def risk_replay_daily(spark, sf):
    """D5"""
    return risk.replay_daily(derive.pii_events(spark, sf), derive.site_checks(spark, sf), derive.now())


@query
def timeline_top25(spark, sf):
    """D2"""
    return dashboard.timeline(*_device_tables(spark, sf), derive.now()).drop("title", "detail")


@query
def flagged_sites(spark, sf):
    """D3, D7"""
    df = dashboard.flagged_sites(derive.site_checks(spark, sf), derive.now())
    shown = dashboard.headline_reasons(F.col("reasons"))
    return df.withColumn("reasons", F.transform(shown, lambda r: r["detail"]))


@query
def device_table(spark, sf):
    """S6"""
    return dashboard.device_table(*_device_tables(spark, sf))


@query
def latest_device(spark, sf):
    """D1"""
    return dashboard.latest_device(dashboard.device_table(*_device_tables(spark, sf)))


def _snapshots(spark, sf):
    return derive.events(spark, sf).select(
        F.concat(F.lit("dev-"), (F.col("user_id") % 10).cast("string")).alias("device_id"),
        F.col("ts").alias("captured_at"),
    )


@query
def snapshots_thinned(spark, sf):
    """S7"""
    return dashboard.thin_snapshots(_snapshots(spark, sf), minutes=60)


@query
def score_trend(spark, sf):
    """D4"""
    replay = risk.replay_daily(derive.pii_events(spark, sf), derive.site_checks(spark, sf), derive.now())
    return dashboard.trend(dashboard.thin_snapshots(replay, minutes=5), derive.now()).select(
        "device_id", "captured_at", "overall"
    )


@query
def dashboard_summary(spark, sf):
    """D6, S12"""
    df = dashboard.summary(*_device_tables(spark, sf), derive.now())
    return df.select(
        "device_id", "overall", "risk_level", "confidence", "privacy", "browsing", "identity",
        F.transform("drivers", lambda d: d["code"]).alias("drivers"), "lever",
        F.transform("recommendations", lambda r: r["action"]).alias("actions"),
        F.transform("timeline", lambda t: t["kind"]).alias("timeline"),
        F.transform("flagged_sites", lambda s: s["domain"]).alias("flagged"),
        "total_pii_events", "total_masked", "total_sites_flagged",
    )


@query
def sessions_as_json(spark, sf):
    """Wire rows as JSON"""
    df = risk.risk_scores(*_device_tables(spark, sf), derive.now()).select("device_id", "overall", "risk_level")
    return tables.as_json(df, ["device_id"])


# --- identity ---------------------------------------------------------------


@query
def identity_live(spark, sf):
    """I4, I5"""
    live = identity.live_checks(derive.identity_checks(spark, sf))
    return live.select("device_id", "key", "occurred_at", "breach_count", "label", "penalty", "risk_level")


@query
def identity_scores(spark, sf):
    """I6, I7, I8"""
    live = identity.live_checks(derive.identity_checks(spark, sf))
    df = identity.identity_totals(live).join(identity.breached_names(live), "device_id", "left")
    return df.select(
        "device_id", risk.curve(F.col("i_penalty")).alias("identity"), "i_checked", "i_breached",
        F.transform("first_breached", lambda x: x["label"]).alias("first_breached"),
        identity.identity_detail(F.col("i_checked"), F.col("i_breached")).alias("sentence"),
    )


def _corpus(spark, sf):
    return corpora.parse_ranges(derive.corpus_lines(spark, sf))


@query
def breach_corpus(spark, sf):
    """S8"""
    return _corpus(spark, sf)


@query
def breach_range(spark, sf):
    """The ranges of the prefixes asked for"""
    asked = derive.secrets(spark, sf).select(
        F.lower(F.substring(F.sha1(F.col("secret").cast("binary")), 1, 5)).alias("hash_prefix")
    ).unionByName(derive.secrets(spark, sf).select(F.col("secret").alias("hash_prefix")))
    return identity.range_lookup(asked, _corpus(spark, sf))


@query
def breach_match(spark, sf):
    """Own-side match of every secret"""
    return identity.match_own(derive.secrets(spark, sf), _corpus(spark, sf)).select(
        "id", "device_id", "prefix", "breach_count"
    )


@query
def breach_plausible(spark, sf):
    """I3"""
    digest = F.upper(F.sha1(F.col("secret").cast("binary")))
    checks = derive.secrets(spark, sf).select(
        "id", F.substring(digest, 1, 5).alias("hash_prefix"), ((F.col("id") % 6) * 37).alias("breach_count")
    )
    rated = identity.rate(identity.plausible(checks, _corpus(spark, sf)))
    return rated.select("id", "hash_prefix", "breach_count", "verified", "penalty", "risk_level", "confidence")


def _buckets(spark, sf):
    """The corpus of all events as a table bucketed by prefix."""
    name = f"ranges_{uuid.uuid4().hex}"
    corpora.write_breach_corpus(corpora.parse_ranges(derive.all_corpus_lines(spark, sf)), name, buckets=64)
    return corpora.read_buckets(spark, name)


@query
def breach_match_bucketed(spark, sf):
    """Own-side match against a stored corpus that stays where it is"""
    return identity.match_own(derive.all_secrets(spark, sf), _buckets(spark, sf), in_place=True).select(
        "id", "device_id", "prefix", "breach_count"
    )


@query
def breach_plausible_bucketed(spark, sf):
    """Reported counts against the stored corpus"""
    digest = F.upper(F.sha1(F.col("secret").cast("binary")))
    checks = derive.all_secrets(spark, sf).select(
        "id", F.substring(digest, 1, 5).alias("hash_prefix"), ((F.col("id") % 6) * 37).alias("breach_count")
    )
    return identity.plausible(checks, _buckets(spark, sf)).select("id", "hash_prefix", "breach_count", "verified")


@query
def prefix_k_anonymity(spark, sf):
    """Crowd per prefix"""
    lines = derive.corpus_lines(spark, sf).withColumn("prefix", F.concat(F.substring("prefix", 1, 2), F.lit("000")))
    return identity.k_anonymity(corpora.parse_ranges(lines))


# --- text scan -----------------------------------------------------------------

_FINDING = ["doc_id", "pii_type", "risk_level", "confidence", "start", "end", "masked_preview", "detection_tier"]


@query
def pii_findings(spark, sf):
    """P1-P14, P20-P27 over the raw documents"""
    docs = tables.read_table(spark, sf, "documents")
    return pii.scan_pii(docs, ["doc_id"]).select(*_FINDING)


@query
def pii_findings_seeded(spark, sf):
    """P1-P14, P20-P27 with every detector hitting"""
    return pii.scan_pii(derive.texts(spark, sf), ["doc_id"]).select(*_FINDING)


@query
def pii_candidates_card(spark, sf):
    """Card candidates before overlaps"""
    from exposure.functions.checksums import card_brand, luhn_ok
    from exposure.functions.spans import guarded_spans

    card = next(d for d in pii.DETECTORS if d.name == "credit_card")
    found = derive.texts(spark, sf).select(
        "doc_id", guarded_spans(F.col("text"), F.col("text").rlike(card.guard), card.pattern).alias("x")
    )
    rows = found.select("doc_id", F.explode_outer("x").alias("m")).filter("m is not null")
    return rows.select(
        "doc_id", F.col("m.s").alias("start"), F.col("m.e").alias("end"),
        luhn_ok(F.col("m.v")).alias("luhn"), card_brand(F.col("m.v")).alias("brand"),
    )


@query
def pii_message_scores(spark, sf):
    """P29"""
    return pii.message_scores(pii.scan_documents(derive.texts(spark, sf)), ["doc_id"])


@query
def pii_redacted(spark, sf):
    """P28"""
    df = pii.redact(pii.scan_documents(derive.texts(spark, sf)))
    return df.select("doc_id", F.length("redacted").alias("n"), F.md5(F.col("redacted").cast("binary")).alias("digest"))


@query
def pii_muted(spark, sf):
    """mutes act before overlaps"""
    docs = derive.texts(spark, sf).withColumn("site_origin", hosts.site_origin(F.col("site_origin")))
    mutes = docs.select("site_origin").distinct().select(
        "site_origin",
        F.explode(
            F.when(F.length("site_origin") % 2 == 0, F.array(F.lit("credit_card"), F.lit("email")))
            .otherwise(F.array(F.lit("upi_id")))
        ).alias("pii_type"),
    )
    return pii.scan_pii(pii.attach_mutes(docs, mutes), ["doc_id"], mutes_col="muted").select(*_FINDING)


@query
def pii_semantic_gate(spark, sf):
    """Which texts a model should read, and the tier status"""
    scanned = pii.scan_documents(derive.texts(spark, sf))
    answered = F.when(F.col("doc_id") % 3 == 0, F.lit(True))
    return scanned.select(
        "doc_id", pii.semantic_gate(scanned).alias("worth_reading"),
        pii.tier_status(scanned, answered).alias("status"),
    )


@query
def pii_ocr_recovered(spark, sf):
    """P30"""
    df = pii.scan_pii(derive.ocr_texts(spark, sf), ["doc_id"], ocr=True)
    return df.filter("detection_tier = 'ocr'").select(*_FINDING)


def _model_findings(docs):
    """Model output derived from the texts: the last word, an invented one, a bad type."""
    word = F.regexp_extract("text", r"([A-Za-z]{4,})[^A-Za-z]*$", 1)
    kinds = F.array(*[F.lit(k) for k in ("postal_address", "security_answer", "family_detail", "nonsense")])
    offer = lambda o, kind, text, conf: F.struct(
        F.lit(o).alias("ord"), kind.alias("type"), text.alias("text"),
        F.lit(conf).cast("double").alias("confidence"), F.lit("model says so").alias("reason"),
    )
    rows = F.array(
        offer(0, F.get(kinds, (F.col("doc_id") % 4).cast("int")), word, 0.95),
        offer(1, F.lit("travel_plan"), F.lit("not in this text at all"), 0.5),
        offer(2, F.lit("health_detail"), F.substring("text", 1, 12), None),
    )
    return docs.filter("doc_id % 3 = 0").select("doc_id", F.inline(rows))


@query
def pii_semantic_import(spark, sf):
    """P31, F7"""
    docs = derive.texts(spark, sf)
    joined = pii.semantic_candidates(docs, _model_findings(docs))
    df = pii.explode_findings(pii.scan_documents(joined, semantic_col="semantic"), ["doc_id"])
    return df.filter("detection_tier = 'llm'").select(*_FINDING)


@query
def credential_prefilter(spark, sf):
    """F6, F9"""
    hit = pii.first_credential(F.col("text"))
    df = settle(derive.texts(spark, sf).withColumn("h", hit), ["h"]).filter("h is not null")
    part = pii.excerpt_around(F.col("text"), F.col("h.s"), F.length("h.value"))
    return df.select("doc_id", "h.prefix", "h.s", "h.masked", F.length(part).alias("excerpt_chars"))


@query
def text_hygiene(spark, sf):
    """F7, F8"""
    noisy = F.concat(F.translate("text", ".", "​"), F.lit(" 12:04 PM"))
    return derive.messages(spark, sf).select(
        "conv_id", "turn", F.length(pii.clean_text(noisy)).alias("n"),
        F.md5(pii.clean_text(noisy).cast("binary")).alias("clean"),
        F.md5(pii.strip_clock(F.concat(F.col("text"), F.lit(" 12:04 PM"))).cast("binary")).alias("unstamped"),
    )


# --- destinations ---------------------------------------------------------------


def _graded(spark, sf):
    found = pii.scan_pii(derive.texts(spark, sf), ["doc_id", "site_origin"])
    return destinations.grade_destinations(found)


@query
def destination_fit(spark, sf):
    """G1-G4"""
    return _graded(spark, sf).select(
        "doc_id", "pii_type", "start", "destination_kind", "destination_name", "destination_fit", "destination_note"
    )


@query
def exposure_crosstab(spark, sf):
    """G5"""
    return destinations.exposure_crosstab(_graded(spark, sf))


# --- sites -----------------------------------------------------------------------


@query
def url_parts(spark, sf):
    """U1, U2, F1, F5"""
    df = urls.parse_urls(derive.urls(spark, sf))
    return df.select(
        "page_id", "host", "domain", "url_key", "list_key",
        hosts.site_origin(F.col("url")).alias("origin"), hosts.is_checkable(F.col("url")).alias("checkable"),
        hosts.host_tokens(F.col("host")).alias("tokens"),
    )


@query
def url_brand(spark, sf):
    """U3-U5"""
    df = urls.score_urls(derive.urls(spark, sf), derive.now())
    return df.select(
        "page_id", F.when(hosts.mismatch(F.col("brand")), F.col("brand.brand")).alias("brand"),
        F.coalesce(F.col("brand.kind") == "lookalike", F.lit(False)).alias("lookalike"),
        urls.brand_penalty(F.col("brand"), F.col("lures")).alias("penalty"), "trust_score", "verdict",
    )


def _site_scores(spark, sf):
    return urls.score_urls(
        derive.urls(spark, sf), derive.now(), derive.registry(spark, sf), derive.threats(spark, sf),
        loaded=F.col("page_id") % 5 != 0,
    )


_SITE = ["page_id", "domain", "trust_score", "verdict", "confidence", "domain_age_days", "safe_browsing_hit", "brand_mismatch"]


@query
def url_trust(spark, sf):
    """U6-U11, S10, S11"""
    df = _site_scores(spark, sf)
    return df.select(*_SITE, F.transform("reasons", lambda r: F.concat_ws(":", r["signal"], r["weight"])).alias("reasons"))


@query
def url_trust_distinct(spark, sf):
    """Each key scored once"""
    df = urls.score_distinct_urls(
        derive.urls(spark, sf), derive.now(), registry=derive.registry(spark, sf), threats=derive.threats(spark, sf)
    )
    return df.select("page_id", "url_key", "trust_score", "verdict", "safe_browsing_hit")


@query
def url_trust_reused(spark, sf):
    """Three runs over all pages, the second within the reuse time and the third beyond it"""
    path, told = scratch(spark) + "/verdicts", None
    tables.start_verdicts(spark, path)
    known = {"registry": derive.registry(spark, sf), "threats": derive.threats(spark, sf)}
    for run, hours in ((1, 0), (2, 1), (3, 7)):
        now = derive.now() + F.expr(f"INTERVAL {hours} HOURS")
        fresh = urls.missing_verdicts(derive.urls(spark, sf), tables.read_verdicts(spark, path, now), now, **known)
        tables.append_verdicts(fresh, path)
        answers = urls.with_verdicts(derive.urls(spark, sf), tables.read_verdicts(spark, path, now), now).select(
            F.lit(run).alias("run"), "page_id", "url_key", "trust_score", "verdict", "safe_browsing_hit", "reused")
        told = answers if told is None else told.unionByName(answers)
    return told


@query
def site_checks_stored(spark, sf):
    """Page checks and payload links that are worth keeping"""
    pages = _site_scores(spark, sf).withColumns(
        {"device_id": F.concat(F.lit("dev-"), F.col("page_id").cast("string")), "occurred_at": derive.now()}
    )
    codes = payloads.payload_site_checks(payloads.score_payloads(derive.payloads(spark, sf), derive.now())).withColumns(
        {"device_id": F.concat(F.lit("pay-"), F.col("payload_id").cast("string")), "occurred_at": derive.now()}
    )
    return tables.site_checks_table(pages).unionByName(tables.site_checks_table(codes)).select(
        "device_id", "domain", "trust_score", "verdict", "safe_browsing_hit", "brand_mismatch"
    )


@query
def site_checks_read(spark, sf):
    """The same checks written by day, and read back through the look-back window"""
    path, now = scratch(spark) + "/site_checks", derive.now()
    at = now - F.make_dt_interval((F.col("page_id") % 60).cast("int"))
    pages = _site_scores(spark, sf).withColumns(
        {"device_id": F.concat(F.lit("dev-"), (F.col("page_id") % 50).cast("string")), "occurred_at": at}
    )
    tables.write_site_checks(pages, path)
    back = tables.read_events(spark, path, now, tables.SITE_CHECKS)
    return back.groupBy("device_id", "verdict").agg(
        F.count("*").alias("n"), F.min("occurred_at").alias("first_at"), F.sum("trust_score").alias("trust"),
        F.count_if("safe_browsing_hit").alias("listed"), F.count_if("brand_mismatch").alias("imitations"),
    )


@query
def registration_dates(spark, sf):
    """Dates out of registry JSON"""
    body = F.concat(
        F.lit('{"events":[{"eventAction":"last changed","eventDate":"2023-01-01T00:00:00Z"},{"eventAction":"'),
        F.when(F.col("page_id") % 3 == 0, "Registration").when(F.col("page_id") % 3 == 1, "registered").otherwise("expiry"),
        F.lit('","eventDate":"2020-02-0'), (F.col("page_id") % 9 + 1).cast("string"), F.lit('T10:00:00Z"}]}'),
    )
    return derive.urls(spark, sf).select("page_id", urls.registration_date(body).alias("registered_at"))


# --- email -------------------------------------------------------------------------


@query
def email_links(spark, sf):
    """E1-E3"""
    df = evidence.add_link_hits(evidence.add_links(derive.emails(spark, sf), "body"))
    return df.select(
        "msg_id", F.transform("links", lambda x: x["host"]).alias("hosts"),
        F.transform("link_hits", lambda h: F.concat_ws(":", h["name"], h["penalty"].cast("string"))).alias("hits"),
    )


@query
def email_sender(spark, sf):
    """E4, E5"""
    df = emails.add_sender_hits(derive.emails(spark, sf), "sender", "reply_to", "subject")
    return df.select(
        "msg_id", "sender_domain",
        F.transform("sender_hits", lambda h: F.concat_ws(":", h["name"], h["penalty"].cast("string"))).alias("hits"),
    )


@query
def email_content(spark, sf):
    """E6-E8"""
    df = derive.emails(spark, sf).withColumn(
        "visible", evidence.strip_markup(F.concat(F.col("subject"), F.lit("\n"), F.col("body")))
    )
    df = evidence.add_content_hits(df, "visible")
    return df.select(
        "msg_id", F.length("visible").alias("visible_chars"),
        F.transform("content_hits", lambda h: h["name"]).alias("hits"),
        F.transform("content_hits", lambda h: h["evidence"]).alias("evidence"),
    )


def _intents(ids, id_col, labels):
    kinds = F.array(*[F.lit(k) for k in labels])
    return ids.filter(F.col(id_col) % 4 == 0).select(
        id_col, F.get(kinds, (F.col(id_col) / 4 % len(labels)).cast("int")).alias("label"),
        F.lit(0.9).alias("confidence"), F.lit("read by a model").alias("rationale"),
        F.array(F.lit("not a quote of it")).alias("quotes"),
    )


_EMAIL_LABELS = ["credential_theft", "benign", "unheard_of", "extortion"]
_SCAM_LABELS = ["otp_fraud", "benign", "unheard_of", "romance_fraud"]


@query
def email_verdict(spark, sf):
    """E9-E14, F4"""
    mails = derive.emails(spark, sf)
    df = emails.score_emails(mails, _intents(mails, "msg_id", _EMAIL_LABELS))
    return df.select(
        "msg_id", "link_penalty", "content_penalty", "sender_penalty", "intent", "risk_score", "verdict",
        "confidence", "n_hits", F.transform("signals", lambda s: F.concat_ws(":", s["signal"], s["weight"])).alias("signals"),
    )


# --- conversations -------------------------------------------------------------------


@query
def conv_assembled(spark, sf):
    """C1"""
    return conversations.assemble(derive.messages(spark, sf)).select(
        "conv_id", "incoming_messages", F.length("incoming_text").alias("chars"), "incoming_text"
    )


@query
def conv_signals(spark, sf):
    """C2, C3"""
    df = conversations.add_talk_hits(conversations.assemble(derive.messages(spark, sf)))
    literal = F.forall("talk_hits", lambda h: F.contains(F.col("incoming_text"), h["evidence"]))
    return df.select(
        "conv_id", F.transform("talk_hits", lambda h: h["name"]).alias("hits"),
        F.transform("talk_hits", lambda h: h["evidence"]).alias("quotes"), literal.alias("all_literal"),
    )


@query
def conv_verdict(spark, sf):
    """C4-C6"""
    talks = conversations.assemble(derive.messages(spark, sf))
    df = conversations.score_conversations(talks, _intents(talks, "conv_id", _SCAM_LABELS))
    return df.select(
        "conv_id", "talk_penalty", "link_penalty", "content_penalty", "intent", "risk_score", "verdict",
        "confidence", "n_hits",
    )


# --- payloads ---------------------------------------------------------------------------


@query
def payload_parsed(spark, sf):
    """Q1-Q3, Q6"""
    df = payloads.parse_payloads(derive.payloads(spark, sf))
    return df.select(
        "payload_id", "kind", "scheme", "upi.payee_vpa", "upi.handle", "upi.payee_name", "upi.amount",
        "upi.amount_unreadable", "upi.note", "upi.merchant_code", "upi.embedded_url", "wifi_ssid", "wifi_open",
        "embedded_urls",
    )


@query
def payload_verdict(spark, sf):
    """Q4-Q8"""
    df = payloads.score_payloads(derive.payloads(spark, sf), derive.now())
    return df.select(
        "payload_id", "kind", "risk_score", "verdict", "confidence",
        F.transform("signals", lambda s: F.concat_ws(":", s["signal"], s["weight"])).alias("signals"),
    )


# --- reviews ----------------------------------------------------------------------------


@query
def review_split(spark, sf):
    """R0"""
    docs = tables.read_table(spark, sf, "documents")
    parts = settle(docs.select("doc_id", reviews.split_pasted(F.col("text")).alias("parts")), ["parts"])
    rows = parts.select("doc_id", F.posexplode("parts").alias("pos", "review"))
    return rows.select("doc_id", "pos", F.length("review").alias("n"), F.md5(F.col("review").cast("binary")).alias("digest"))


@query
def review_language(spark, sf):
    """R1"""
    return reviews.language_hits(derive.reviews(spark, sf)).select(
        "review_id", F.transform("language_hits", lambda h: h["name"]).alias("hits")
    )


@query
def review_near_dups(spark, sf):
    """R2"""
    return reviews.near_duplicates(derive.reviews(spark, sf))


@query
def review_set_score(spark, sf):
    """R3-R5, R7"""
    rows = derive.reviews(spark, sf)
    model = rows.select("set_id").distinct().filter(F.length("set_id") == 4).select(
        "set_id", F.lit(55).alias("ai_score")
    )
    return reviews.set_scores(rows, model).select(
        "set_id", "n", "dup_pairs", "language_penalty", "pattern_penalty", "reviewer_penalty",
        "risk_score", "verdict", "confidence",
    )


@query
def review_item_score(spark, sf):
    """R6"""
    rows = derive.reviews(spark, sf)
    return reviews.item_scores(rows, reviews.set_scores(rows))


# --- retrieval -----------------------------------------------------------------------------


@query
def bm25_top3(spark, sf):
    """B1-B4"""
    df = retrieval.bm25_topk(derive.questions(spark, sf), derive.cards(spark, sf))
    return df.withColumn("score", F.round("score", 6))


@query
def bm25_top3_indexed(spark, sf):
    """From a stored index whose blocks are opened only if they can matter"""
    name = f"cards_{uuid.uuid4().hex}"
    card_index.write_index(derive.cards(spark, sf), name)
    df = card_index.topk(derive.questions(spark, sf), card_index.read_index(spark, name))
    return df.withColumn("score", F.round("score", 6))


@query
def assistant_answers(spark, sf):
    """Personal questions see the device's own cards"""
    own = retrieval.posture_cards(_told(spark, sf))
    asked = derive.questions(spark, sf).withColumn(
        "device_id", F.concat(F.lit("dev-"), F.col("qid").cast("string"))
    )
    pool = derive.cards(spark, sf)
    ranked = retrieval.bm25_topk(asked, pool, own)
    df = retrieval.answers(asked, ranked, pool, own)
    return df.select("qid", "answered", "sources", "personal_context_used", F.length("answer").alias("answer_chars"))


# --- stored tables -----------------------------------------------------------------------------


@query
def findings_stored(spark, sf):
    """Written partitioned by day, read back through the look-back window"""
    path = scratch(spark) + "/findings"
    stamped = derive.texts(spark, sf).withColumns({
        "device_id": F.concat(F.lit("dev-"), (F.col("doc_id") % 50).cast("string")),
        "occurred_at": derive.now() - F.make_dt_interval((F.col("doc_id") % 60).cast("int")),
        "field_kind": F.lit("text"),
    })
    tables.write_findings(pii.scan_documents(stamped), path)
    back = tables.read_events(spark, path, derive.now())
    return back.groupBy("device_id", "pii_type").agg(
        F.count("*").alias("n"), F.min("occurred_at").alias("first_at"), F.max("masked_preview").alias("last_mask")
    )


@query
def identity_stored(spark, sf):
    """No window on identity"""
    path = scratch(spark) + "/identity"
    rows = derive.identity_checks(spark, sf).withColumn("hash_prefix", F.lower("hash_prefix"))
    tables.write_identity(rows, path)
    back = tables.read_identity(spark, path)
    return back.groupBy("device_id", "hash_prefix").agg(F.count("*").alias("n"), F.max("breach_count").alias("worst"))


@query
def stored_dashboard(spark, sf):
    """Events are stored, read back and scored"""
    base, now = scratch(spark), derive.now()
    kinds = (
        (derive.pii_events(spark, sf), tables.PII_EVENTS), (derive.site_checks(spark, sf), tables.SITE_CHECKS),
        (derive.identity_checks(spark, sf), tables.IDENTITY_CHECKS),
    )
    for n, (rows, schema) in enumerate(kinds):
        tables.append_rows(rows, f"{base}/{n}", schema)
    back = [tables.read_events(spark, f"{base}/{n}", now, schema, days=36_500) for n, (_, schema) in enumerate(kinds)]
    df = dashboard.summary(*back, now)
    return df.select("device_id", "overall", "risk_level", "privacy", "browsing", "identity", "lever", "total_pii_events", "total_sites_flagged")


@query
def scores_from_day_sums(spark, sf):
    """K3, K5: events stored, days summed once, the score read from the sums"""
    base = scratch(spark)
    rows = {"pii": derive.pii_events(spark, sf), "site": derive.site_checks(spark, sf)}
    paths = {kind: f"{base}/{kind}_events" for kind in rows}
    for kind, df in rows.items():
        tables.append_rows(df, paths[kind], day_sums.KINDS[kind], spread=1)
    day_sums.start(spark, f"{base}/sums")
    day_sums.refresh(spark, f"{base}/sums", paths)
    return day_sums.scores(spark, f"{base}/sums", paths, derive.now())


@query
def scores_stored(spark, sf):
    """Score snapshots are stored and read back"""
    path = scratch(spark) + "/snapshots"
    tables.write_snapshots(risk.risk_scores(*_device_tables(spark, sf), derive.now()), derive.now(), path)
    return tables.read_snapshots(spark, path).select("device_id", "captured_at", "overall", "privacy", "identity", "browsing")


@query
def cards_read(spark, sf):
    """A folder of card files, one per benchmark item"""
    path = scratch(spark) + "/cards"
    items = tables.read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("card"),
        F.concat(F.lit("---\nid: item-"), F.col("item_id").cast("string"), F.lit("\ntags: [a, b]\n---\n"), F.col("text")).alias("value"),
    )
    items.write.partitionBy("card").text(path)
    return corpora.read_cards(spark, path).select("id", "tags", F.md5(F.col("body").cast("binary")).alias("digest"))


@query
def cards_parsed(spark, sf):
    """S9"""
    doc = F.concat(
        F.lit("---\nid: card-"), F.col("doc_id").cast("string"), F.lit("\ntitle: Topic "), F.col("source"),
        F.lit("\ntags: ["), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]\n---\n\n"), F.col("text"),
    )
    files = tables.read_table(spark, sf, "documents").select(
        F.concat(F.lit("/cards/file_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(doc).alias("text"),
    )
    return corpora.parse_cards(files).select(
        "id", "title", "tags", "summary", F.length("body").alias("n"), F.md5(F.col("body").cast("binary")).alias("digest")
    )


# --- streams: the file table replayed through the streaming plan -----------------------------------


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files."""
    path = f"{sf}/{name}.parquet"
    # a stream takes no single file by its name, but whatever a pattern matches
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


def _drain(spark, df: DataFrame) -> DataFrame:
    """Run an append stream to its end into Parquet and read that back."""
    base = scratch(spark)
    q = (
        df.writeStream.format("parquet").option("checkpointLocation", f"{base}/check")
        .outputMode("append").trigger(availableNow=True).start(f"{base}/out")
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _drain_timed(spark, df: DataFrame, key: str) -> DataFrame:
    """As ``_drain``, for operators with timers, and without the row that ended the input."""
    name, provider = streams.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        return _drain(spark, df).filter(F.col(key) != "")
    finally:
        spark.conf.set(name, before)


def _ended(spark, stream: DataFrame, key: str, time: str) -> DataFrame:
    """Keys and times of a stream that ends: a last row of no key, far ahead, lets the watermark pass all others."""
    path = scratch(spark)
    last = spark.range(1).select(F.lit("").alias(key), F.lit("2200-01-01").cast("timestamp").alias(time))
    last.write.parquet(path)
    return stream.select(key, time).unionByName(spark.readStream.schema(last.schema).parquet(path))


def _event_stream(spark, sf):
    return _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_live_counts(spark, sf):
    """Windows closed by the watermark"""
    ev = _event_stream(spark, sf).selectExpr(*derive._columns(derive.PII_EVENTS))
    return _drain(spark, streams.live_counts(ev, late="1 hour", size="6 hours"))


@query
def stream_debounced(spark, sf):
    """The last state of each burst"""
    typed = _event_stream(spark, sf).select(
        (F.col("user_id") % 5).cast("string").alias("device_id"), F.lit("f").alias("field_id"), "ts",
        F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"),
    )
    return _drain(spark, streams.debounce(typed, gap="10 minutes", late="1 minute"))


@query
def stream_typed_findings(spark, sf):
    """Typed states rest, pass the length gate, are scanned and stored"""
    base, before = scratch(spark), spark.conf.get(streams.STATE_STORE[0])
    typed = _event_stream(spark, sf).selectExpr(*derive._columns(derive.TYPED))
    end = spark.range(1).selectExpr("'' AS device_id", "'' AS field_id", "'text' AS field_type", "timestamp'2200-01-01' AS ts")
    end.write.parquet(f"{base}/end")
    ended = typed.unionByName(spark.readStream.schema(end.schema).parquet(f"{base}/end"), allowMissingColumns=True)
    spark.conf.set(*streams.STATE_STORE)
    try:
        q = (
            streams.typed_findings(ended, gap_ms=21_600_000, late="1 minute", forget_minutes=10_080).writeStream
            .option("checkpointLocation", f"{base}/check")
            .foreachBatch(lambda batch, i: streams.store_findings(batch, i, f"{base}/out"))
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        spark.conf.set(streams.STATE_STORE[0], before)
    return spark.read.parquet(f"{base}/out").select("device_id", "site_origin", "occurred_at", "pii_type", "masked_preview")


@query
def stream_settled_chats(spark, sf):
    """Chats scored once quiet"""
    talk = _stream(spark, sf, "conversations").filter("role <> 'system'").selectExpr(
        "timestamp_seconds(1700000000 + conv_id * 1000 + turn) AS ts", *derive._columns(derive.MESSAGES)
    )
    df = _drain(spark, streams.settled_conversations(talk).select("conv_id", "settled_at", "risk_score", "verdict"))
    return df


@query
def stream_fresh_alerts(spark, sf):
    """One alert per key within the reuse time"""
    checks = _event_stream(spark, sf).select(
        F.concat(F.lit("k"), (F.col("event_id") % 97).cast("string")).alias("key"), "ts"
    )
    return _drain_timed(spark, streams.fresh_keys(_ended(spark, checks, "key", "ts"), "key"), "key")


@query
def stream_thinned(spark, sf):
    """T4"""
    snaps = _event_stream(spark, sf).select(
        F.concat(F.lit("dev-"), (F.col("user_id") % 10).cast("string")).alias("device_id"),
        F.col("ts").alias("captured_at"),
    )
    ended = _ended(spark, snaps, "device_id", "captured_at")
    return _drain_timed(spark, streams.thin_snapshots(ended, minutes=60, late="10 minutes"), "device_id")


@query
def stream_findings(spark, sf):
    """Scanned as they arrive, stored once per batch"""
    base = scratch(spark)
    texts = _stream(spark, sf, "documents").selectExpr(*derive._columns(derive.TEXTS)).withColumns({
        "device_id": F.concat(F.lit("dev-"), (F.col("doc_id") % 50).cast("string")),
        "occurred_at": derive.now(), "field_kind": F.lit("text"),
    })
    q = (
        streams.live_findings(texts).writeStream.option("checkpointLocation", f"{base}/check")
        .foreachBatch(lambda batch, i: streams.store_findings(batch, i, f"{base}/out"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    back = spark.read.parquet(f"{base}/out")
    return back.groupBy("device_id", "pii_type").agg(F.count("*").alias("n"))


@query
def stream_incremental_score(spark, sf):
    """Day sums from the stream, scored later"""
    base = scratch(spark)
    ev = _event_stream(spark, sf).selectExpr(*derive._columns(derive.PII_EVENTS))
    path = f"{base}/days"
    q = (
        streams.daily_penalties(ev).writeStream.outputMode("update").option("checkpointLocation", f"{base}/check")
        .foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/batch={i}"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    days = spark.read.parquet(path).groupBy("device_id", "day_end").agg(F.max_by("penalty", "batch").alias("penalty"))
    at = F.lit("2024-02-06 00:00:00").cast("timestamp")
    return streams.score_from_days(days, at).select("device_id", "privacy")


@query
def stream_score_from_state(spark, sf):
    """Day sums read from the state store, which does not grow with batches"""
    base = scratch(spark)
    ev = _event_stream(spark, sf).selectExpr(*derive._columns(derive.PII_EVENTS))
    q = (
        streams.daily_penalties(ev).writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    at = F.lit("2024-02-06 00:00:00").cast("timestamp")
    return streams.score_from_days(streams.days_in_state(spark, f"{base}/check"), at).select("device_id", "privacy")
