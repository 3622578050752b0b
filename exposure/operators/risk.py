"""The time-decayed risk score of every device.

Penalties are sums, so everything starts as a partial aggregation on fine keys
(device + origin, device + domain, device + password) and is folded up to the device.
A hot device is spread over those keys first and arrives at the last step as a few
partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure import dims
from exposure.functions.basics import compact, half_up, pick, plural, settle
from exposure.operators import identity as ident

RESOLVED = ("masked", "allowlisted")
OPEN = ("none", "ignored")
SEVERE = ("high", "critical")


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(8.64e10)


def decay(at: Column, now: Column) -> Column:
    """Halves every seven days; an event from the future counts as fresh."""
    return F.pow(F.lit(0.5), F.greatest(age_days(at, now), F.lit(0.0)) / dims.HALF_LIFE_DAYS)


def curve(penalty: Column) -> Column:
    """Penalty to score: 100 when nothing is wrong, saturating towards 0."""
    k = F.lit(dims.SATURATION_K)
    return F.when(penalty <= 0, F.lit(100)).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), half_up(F.lit(100.0) * (k / (k + penalty)))))
    )


def points(score: Column, weight: Column) -> Column:
    return F.coalesce(F.round(score * weight, 1), F.lit(0.0))


def overall(privacy: Column, browsing: Column, identity: Column) -> Column:
    """Weighted score; the weight of a missing part goes to the parts that answered."""
    wp, wb, wi = weights(identity)
    total = points(privacy, wp) + points(browsing, wb) + points(identity, wi)
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(total)))


def weights(identity: Column) -> tuple[Column, Column, Column]:
    w = dims.WEIGHTS
    without = w["privacy"] + w["browsing"]
    missing = identity.isNull()
    return (
        F.when(missing, w["privacy"] / without).otherwise(w["privacy"]),
        F.when(missing, w["browsing"] / without).otherwise(w["browsing"]),
        F.when(missing, 0.0).otherwise(w["identity"]),
    )


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 80, "low").when(score >= 60, "medium").when(score >= 35, "high")
        .otherwise("critical")
    )


def in_window(at: Column, now: Column) -> Column:
    return at >= now - F.expr(f"INTERVAL {dims.LOOKBACK_DAYS} DAYS")


def pii_penalty(now: Column) -> Column:
    base = pick(dims.PII_BASE_PENALTY, F.col("risk_level"), dims.PII_BASE_PENALTY["medium"])
    action = pick(dims.PII_ACTION_FACTOR, F.col("action_taken"), 1.0)
    return base * action * decay(F.col("occurred_at"), now) * F.col("confidence")


def bare_host(origin: Column) -> Column:
    return F.replace(F.replace(origin, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))


def pii_totals(events: DataFrame, now: Column) -> DataFrame:
    level, action = F.col("risk_level"), F.col("action_taken")
    cause = (
        F.when(action.isin(*RESOLVED), "resolved").when(level.isin(*SEVERE), "severe")
        .otherwise("minor")
    )
    rows = events.filter(in_window(F.col("occurred_at"), now)).select(
        "device_id",
        "site_origin",
        cause.alias("cause"),
        action.alias("action"),
        (level.isin(*SEVERE) & action.isin(*OPEN)).alias("open"),
        pii_penalty(now).alias("p"),
    )

    def of(name: str, value: Column) -> Column:
        return F.sum(F.when(F.col("cause") == name, value).otherwise(F.lit(0.0)))

    def count(name: str) -> Column:
        return F.count_if(F.col("cause") == name)

    per_origin = rows.groupBy("device_id", "site_origin").agg(
        F.sum("p").alias("p"), F.count("*").alias("n"),
        *[of(c, F.col("p")).alias(f"p_{c}") for c in ("severe", "minor", "resolved")],
        *[count(c).alias(f"n_{c}") for c in ("severe", "minor", "resolved")],
        F.count_if(F.col("open")).alias("n_open"),
        F.count_if(F.col("action") == "masked").alias("n_masked"),
        F.count_if(F.col("action") == "allowlisted").alias("n_muted"),
    )
    sums = ["p", "n", "p_severe", "p_minor", "p_resolved", "n_severe", "n_minor", "n_resolved",
            "n_open", "n_masked", "n_muted"]
    per_host = per_origin.groupBy("device_id", bare_host(F.col("site_origin")).alias("host")).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count_if(F.col("n_open") > 0).alias("open_origins"),
        F.min(F.when(F.col("n_open") > 0, F.col("site_origin"))).alias("open_first"),
    )
    return per_host.groupBy("device_id").agg(
        *[F.sum(c).alias(f"e_{c}") for c in sums],
        F.sum("open_origins").alias("e_open_origins"),
        F.min("open_first").alias("e_open_first"),
        F.count_if(F.col("n_severe") > 0).alias("e_severe_hosts"),
        F.min(F.when(F.col("n_severe") > 0, F.col("host"))).alias("e_severe_first"),
    )


def worst_per_domain(checks: DataFrame) -> DataFrame:
    """Per device and domain: the worst penalty, and the latest time it was seen."""
    base = pick(dims.SITE_BASE_PENALTY, F.col("verdict"), 0.0)
    return (
        checks.withColumn("base", base)
        .groupBy("device_id", "domain")
        .agg(F.max(F.struct("base", "occurred_at")).alias("w"), F.count("*").alias("visits"))
        .select("device_id", "domain", "visits", "w.base", "w.occurred_at")
    )


_WORST = {"dangerous": 100.0, "suspicious": 30.0, "unknown": 5.0}


def site_totals(checks: DataFrame, now: Column) -> DataFrame:
    worst = worst_per_domain(checks.filter(in_window(F.col("occurred_at"), now)))
    p = F.col("base") * decay(F.col("occurred_at"), now)
    aggs = [F.sum(p).alias("s_p"), F.sum("visits").alias("s_n")]
    for verdict, base in _WORST.items():
        mine = F.col("base") == base
        aggs += [
            F.sum(F.when(mine, p).otherwise(F.lit(0.0))).alias(f"s_p_{verdict}"),
            F.count_if(mine).alias(f"s_n_{verdict}"),
            F.min(F.when(mine, F.col("domain"))).alias(f"s_first_{verdict}"),
        ]
    return worst.groupBy("device_id").agg(*aggs)


def device_totals(
    events: DataFrame, checks: DataFrame, identity_checks: DataFrame, now: Column,
    devices: DataFrame | None = None,
) -> DataFrame:
    """One row per device with every sum the score, advice and narrative need.

    The parts are unioned and aggregated once, which is one exchange in place of two
    outer joins.  A device without password checks keeps NULL identity columns.
    ``devices`` may name who gets a row; without it the event tables are read once more,
    for the device column only and past the window, so nobody is lost.
    """
    live = ident.live_checks(identity_checks)
    parts = [
        pii_totals(events, now),
        site_totals(checks, now),
        ident.identity_totals(live),
        ident.breached_names(live),
    ]
    if devices is None:
        devices = events.select("device_id").unionByName(checks.select("device_id")).unionByName(
            identity_checks.select("device_id")
        )
    everyone = devices.groupBy("device_id").agg(F.lit(True).alias("seen"))
    merged = everyone
    for part in parts:
        merged = merged.unionByName(part, allowMissingColumns=True)
    columns = [c for c in merged.columns if c not in ("device_id", "seen")]
    folded = merged.groupBy("device_id").agg(*[F.max(c).alias(c) for c in columns])
    zeros = {
        c: 0 for c in columns
        if c[:2] in ("e_", "s_") and "first" not in c
    }
    return folded.fillna(zeros)


def add_scores(totals: DataFrame) -> DataFrame:
    parts = (
        totals.withColumn("privacy", curve(F.col("e_p")))
        .withColumn("browsing", curve(F.col("s_p")))
        .withColumn("identity", F.when(F.col("i_checked").isNotNull(), curve(F.col("i_penalty"))))
    )
    return (
        settle(parts, ["privacy", "browsing", "identity"])
        .withColumn("overall", overall(F.col("privacy"), F.col("browsing"), F.col("identity")))
        .withColumn("risk_level", risk_level(F.col("overall")))
        .withColumn("confidence", F.when(F.col("identity").isNull(), 0.8).otherwise(1.0))
    )


def risk_scores(events: DataFrame, checks: DataFrame, identity_checks: DataFrame, now: Column) -> DataFrame:
    """Scores, level, confidence, headline and counters of every device."""
    scored = add_scores(device_totals(events, checks, identity_checks, now))
    return scored.select(
        "device_id", "overall", "privacy", "browsing", "identity", "risk_level", "confidence",
        headline().alias("headline"),
        F.col("e_n").alias("pii_events"),
        F.col("e_n_masked").alias("masked_events"),
        (F.col("s_n_dangerous") + F.col("s_n_suspicious")).alias("flagged_domains"),
    )


def headline() -> Column:
    level = F.col("risk_level")
    return (
        F.when((F.col("e_n") == 0) & (F.col("s_n") == 0), "Nothing has been seen yet.")
        .when(level == "low", "All good: nothing needs attention.")
        .when(level == "medium", "Mostly fine; a couple of things deserve a look.")
        .when(level == "high", "Some things need attention, the first advice first.")
        .otherwise("Serious issues need attention today.")
    )


def contributions(scored: DataFrame) -> DataFrame:
    """Three rows per device that add up to its score."""
    wp, wb, wi = weights(F.col("identity"))
    n_e, n_s = F.col("e_n"), F.col("s_n")
    flagged = F.col("s_n_dangerous") + F.col("s_n_suspicious")
    privacy_note = (
        F.when(n_e == 0, "Nothing sensitive was typed.")
        .when(F.col("privacy") >= 80, F.concat(n_e.cast("string"), plural(n_e, " finding", " findings"), F.lit(", minor or masked.")))
        .otherwise(F.concat(n_e.cast("string"), plural(n_e, " sensitive detail", " sensitive details"), F.lit(" typed.")))
    )
    browsing_note = (
        F.when(n_s == 0, "No risky site was visited.")
        .when(flagged == 0, "Some sites could not be checked in full.")
        .otherwise(F.concat(flagged.cast("string"), plural(flagged, " site", " sites"), F.lit(" flagged.")))
    )

    def row(name: str, weight: Column, note: Column, n: Column) -> Column:
        score = F.col(name)
        return F.struct(
            F.lit(name).alias("component"),
            score.alias("score"),
            F.lit(dims.WEIGHTS[name]).alias("weight"),
            F.round(weight, 3).alias("weight_applied"),
            points(score, weight).alias("points"),
            note.alias("detail"),
            n.cast("long").alias("event_count"),
        )

    rows = F.array(
        row("privacy", wp, privacy_note, n_e),
        row("browsing", wb, browsing_note, n_s),
        row("identity", wi, ident.identity_detail(F.col("i_checked"), F.col("i_breached")), F.coalesce("i_checked", F.lit(0))),
    )
    return scored.select("device_id", F.inline(rows))


def _others(n: Column) -> Column:
    extra = n - 1
    return F.when(n > 1, F.concat(F.lit(" and "), extra.cast("string"), plural(extra, " other", " others"))).otherwise("")


def recommendation_array() -> Column:
    """At most four pieces of advice, most severe first, worded from the counts alone."""
    n_b = F.coalesce(F.col("i_breached"), F.lit(0))
    # two are named and the others counted; an array of all names is never in a sentence
    names = F.array_join(F.transform(F.slice("first_breached", 1, 2), lambda x: x["label"]), ", ")
    n_open, n_d, n_s = F.col("e_n_open"), F.col("s_n_dangerous"), F.col("s_n_suspicious")
    n_muted = F.col("e_n_muted")

    def advise(priority: str, action: str, n: Column, title: Column, detail: Column) -> Column:
        return F.struct(
            F.lit(priority).alias("priority"), F.lit(action).alias("action"),
            n.cast("long").alias("subjects"), title.alias("title"), detail.alias("detail"),
        )

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    extra = F.when(n_b > 2, say(" and ", (n_b - 2).cast("string"), " more")).otherwise("")
    all_rules = compact(
        F.when(n_b > 0, advise(
            "high", "change_password", n_b,
            say(n_b.cast("string"), plural(n_b, " password is", " passwords are"), " in breaches"),
            say("Change now: ", names, extra, "."),
        )),
        F.when(n_open > 0, advise(
            "high", "review_pii", n_open,
            say(n_open.cast("string"), plural(n_open, " sensitive detail", " sensitive details"), " sent unmasked"),
            say("Typed on ", bare_host(F.col("e_open_first")), _others(F.col("e_open_origins")), "."),
        )),
        F.when(n_d > 0, advise(
            "high", "review_sites", n_d,
            say(n_d.cast("string"), plural(n_d, " likely scam site", " likely scam sites"), " visited"),
            say("Among them ", F.col("s_first_dangerous"), "."),
        )),
        F.when((n_s > 0) & (n_d == 0), advise(
            "medium", "review_sites", n_s,
            say(n_s.cast("string"), plural(n_s, " odd site", " odd sites"), " visited"),
            say("Among them ", F.col("s_first_suspicious"), "."),
        )),
        F.when(n_muted >= 3, advise(
            "low", "review_allowlist", n_muted, F.lit("Several warnings are muted"),
            say(n_muted.cast("string"), " muted findings are worth a second look."),
        )),
        F.when(F.col("i_checked").isNull(), advise(
            "low", "setup_identity", F.lit(0), F.lit("No password checked yet"),
            F.lit("One of three parts of the score is missing."),
        )),
    )
    return F.slice(all_rules, 1, 4)


def recommendations(scored: DataFrame) -> DataFrame:
    return scored.select(
        "device_id", F.posexplode(recommendation_array()).alias("rank", "r")
    ).select("device_id", "rank", "r.*")


# ---------------------------------------------------------------------------
# Replay: the score as it stood on each past day
# ---------------------------------------------------------------------------


def replay_daily(events: DataFrame, checks: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Score every device as of ``now - d`` days, d = days..0, from what was known then.

    Window edges fall on whole days before ``now``, so events are first summed into day
    buckets (decayed to the bucket's end) and only buckets meet the days they are
    visible on.  An event exactly on an edge is in both windows it borders and
    gets its own bucket.
    """
    day_us = 86_400_000_000
    lookback = dims.LOOKBACK_DAYS

    def bucketed(df: DataFrame) -> DataFrame:
        age = F.unix_micros(now) - F.unix_micros("occurred_at")
        k = F.floor(age / F.lit(day_us)).cast("int")
        return (
            df.withColumn("k", k)
            .withColumn("edge", F.unix_micros("occurred_at") == F.unix_micros(now) - F.col("k").cast("long") * day_us)
            .filter((F.col("k") >= 0) & (F.col("k") <= days + lookback))
        )

    # an event in bucket k was known from day k on, and for 30 days
    first_day = F.greatest(F.lit(0), F.col("k") - lookback + F.when(F.col("edge"), 0).otherwise(1))
    last_day = F.least(F.lit(days), F.col("k"))
    visible = F.when(first_day <= last_day, F.sequence(first_day, last_day)).otherwise(
        F.array().cast("array<int>")
    )

    def faded(days_between: Column) -> Column:
        return F.pow(F.lit(0.5), days_between / dims.HALF_LIFE_DAYS)

    end_of_bucket = F.timestamp_micros(F.unix_micros(now) - F.col("k").cast("long") * day_us)
    sums = (
        bucketed(events)
        .groupBy("device_id", "k", "edge")
        .agg(F.sum(pii_penalty(end_of_bucket)).alias("p"))
        .withColumn("d", F.explode(visible))
        .groupBy("device_id", "d")
        .agg(F.sum(F.col("p") * faded(F.col("k") - F.col("d"))).alias("e_p"))
    )
    base = pick(dims.SITE_BASE_PENALTY, F.col("verdict"), 0.0)
    site = (
        bucketed(checks.withColumn("base", base).filter(F.col("base") > 0))
        .groupBy("device_id", "domain", "k", "edge")
        .agg(F.max(F.struct("base", "occurred_at")).alias("w"))
        .withColumn("d", F.explode(visible))
        .groupBy("device_id", "d", "domain")
        .agg(F.max("w").alias("w"))
        .withColumn("as_of", F.timestamp_micros(F.unix_micros(now) - F.col("d").cast("long") * day_us))
        .groupBy("device_id", "d")
        .agg(F.sum(F.col("w.base") * decay(F.col("w.occurred_at"), F.col("as_of"))).alias("s_p"))
    )
    calendar = (
        events.select("device_id").unionByName(checks.select("device_id"))
        .groupBy("device_id").agg(F.lit(0.0).alias("e_p"), F.lit(0.0).alias("s_p"))
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(days))))
    )
    merged = calendar.unionByName(sums, allowMissingColumns=True).unionByName(
        site, allowMissingColumns=True
    )
    none = F.lit(None).cast("int")
    return (
        merged.groupBy("device_id", "d")
        .agg(F.sum("e_p").alias("e_p"), F.sum("s_p").alias("s_p"))
        .select(
            "device_id",
            F.timestamp_micros(F.unix_micros(now) - F.col("d").cast("long") * day_us).alias("captured_at"),
            curve(F.col("e_p")).alias("privacy"),
            curve(F.col("s_p")).alias("browsing"),
        )
        .withColumn("overall", overall(F.col("privacy"), F.col("browsing"), none))
    )
