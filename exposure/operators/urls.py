"""Site trust: threat list, domain age and brand impersonation folded into a verdict.

A check that did not run stays NULL and leaves the denominator; it is never a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure import dims
from exposure.functions import hosts
from exposure.functions.basics import compact, first, half_even, pick, plural, settle

# Weights and bands.
W_LIST, W_AGE, W_BRAND = 0.45, 0.25, 0.30
MIN_WEIGHT = 0.31
LAG_DISCOUNT = 0.5
IMPERSONATION_CAP = 25
REUSE_HOURS = 6

REASON = "struct<signal:string,detail:string,weight:string>"


def _reason(signal: str, detail: Column, weight: str) -> Column:
    return F.struct(
        F.lit(signal).alias("signal"), detail.alias("detail"), F.lit(weight).alias("weight")
    ).cast(REASON)


def parse_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host, domain, url_key`` (the reuse key) and ``list_key`` (no query, no fragment)."""
    url = hosts.with_scheme(F.col(url_col))
    path = hosts.url_path(url)
    return (
        urls.withColumn("host", hosts.url_host(url))
        .withColumn("domain", hosts.registrable(F.col("host")))
        .withColumn(
            "url_key",
            F.concat(
                hosts.url_scheme(url), F.lit("://"), F.col("host"),
                F.when(path == "", "/").otherwise(path),
            ),
        )
        .withColumn(
            "list_key",
            F.concat(hosts.url_scheme(url), F.lit("://"), hosts.url_netloc(url), path),
        )
    )


def domain_age(df: DataFrame, registry: DataFrame | None, now: Column) -> DataFrame:
    """Left join the registry; ``domain_age_days`` is NULL where the date is not known."""
    if registry is None:
        return df.withColumn("domain_age_days", F.lit(None).cast("int"))
    dates = registry.groupBy("domain").agg(F.min("registered_at").alias("_registered"))
    seconds = F.unix_micros(now) - F.unix_micros("_registered")
    age = F.greatest(F.lit(0), F.floor(seconds / F.lit(86_400_000_000))).cast("int")
    known = F.when(F.col("_registered").isNotNull(), age)  # greatest() skips NULL
    return df.join(dates, "domain", "left").withColumn("domain_age_days", known).drop("_registered")


def registration_date(rdap_json: Column) -> Column:
    """Registration time in a registry's JSON answer, NULL if it has none."""
    schema = "events array<struct<eventAction:string,eventDate:string>>"
    events = F.from_json(rdap_json, schema)["events"]
    dates = F.filter(
        F.transform(
            F.filter(
                events,
                lambda e: F.lower(e["eventAction"]).isin("registration", "registered"),
            ),
            lambda e: F.try_to_timestamp(e["eventDate"]),
        ),
        lambda t: t.isNotNull(),
    )
    return first(dates)


def threat_lookup(
    df: DataFrame, threats: DataFrame | None, loaded: Column | None = None
) -> DataFrame:
    """Three-valued ``listed`` (NULL: not checked) and the ``threats`` found.

    ``loaded`` says per row whether the list answered; without it an absent table is
    the only reason for NULL.
    """
    if threats is None:
        return df.withColumn("listed", F.lit(None).cast("boolean")).withColumn(
            "threats", F.lit(None).cast("array<string>")
        )
    known = threats.groupBy(F.col("url").alias("list_key")).agg(
        F.array_sort(F.collect_set(pick(dims.THREAT_LABELS, F.col("threat")))).alias("threats")
    )
    hit = F.col("threats").isNotNull()
    listed = hit if loaded is None else F.when(loaded, hit)
    return df.join(known, "list_key", "left").withColumn("listed", listed)


def age_penalty(days: Column) -> Column:
    return (
        F.when(days <= 7, 1.0).when(days <= 30, 0.8).when(days <= 180, 0.4)
        .when(days <= 365, 0.15).when(days.isNotNull(), 0.0)
    )


def brand_penalty(brand: Column, lures: Column) -> Column:
    return (
        F.when(~hosts.mismatch(brand), 0.0)
        .when(brand["kind"] == "lookalike", 1.0)
        .when(F.size(lures) > 0, 0.9)
        .otherwise(0.55)
    )


def _age_reason(days: Column) -> Column:
    n = days.cast("string")
    months = F.floor(days / 30).cast("string")
    years = F.floor(days / 365)
    fresh = F.concat(F.lit("Registered "), n, plural(days, " day", " days"), F.lit(" ago."))
    old = F.concat(
        F.lit("Registered over "), years.cast("string"), plural(years, " year", " years"), F.lit(" ago.")
    )
    some = F.concat(F.lit("Registered about "), months, F.lit(" months ago."))
    return (
        F.when(days.isNull(), _reason("domain_age", F.lit("The age of this address is not known."), "unknown"))
        .when(days <= 30, _reason("domain_age", fresh, "bad"))
        .when(days <= 180, _reason("domain_age", some, "bad"))
        .when(days <= 365, _reason("domain_age", some, "good"))
        .otherwise(_reason("domain_age", old, "good"))
    )


def score_urls(
    urls: DataFrame,
    now: Column,
    registry: DataFrame | None = None,
    threats: DataFrame | None = None,
    loaded: Column | None = None,
    url_col: str = "url",
) -> DataFrame:
    """Add trust score, verdict, reasons and confidence to each URL row."""
    df = parse_urls(urls, url_col)
    df = threat_lookup(domain_age(df, registry, now), threats, loaded)
    df = df.withColumn(
        "brand", F.when(hosts.brand_suspected(F.col("host")), hosts.check_brand(F.col("host")))
    ).withColumn("lures", hosts.lures_in(F.col("host")))
    return _verdicts(settle(df, ["brand", "lures"]))


def _verdicts(df: DataFrame) -> DataFrame:
    brand, lures, days, listed = (F.col(c) for c in ("brand", "lures", "domain_age_days", "listed"))
    bad_brand = hosts.mismatch(brand)
    credit = F.when(F.coalesce(days > 30, F.lit(False)), 1.0).otherwise(LAG_DISCOUNT)
    available = (
        F.lit(W_BRAND)
        + F.when(days.isNotNull(), W_AGE).otherwise(0.0)
        + F.when(listed == F.lit(False), F.lit(W_LIST) * credit).otherwise(0.0)
    )
    penalty = F.lit(W_BRAND) * brand_penalty(brand, lures) + F.coalesce(
        F.lit(W_AGE) * age_penalty(days), F.lit(0.0)
    )
    df = df.withColumn("_available", available).withColumn("_penalty", penalty)
    raw = half_even(F.lit(100) * (F.lit(1) - F.col("_penalty") / F.col("_available")))
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    active = bad_brand & ((brand["kind"] == "lookalike") | (F.size(lures) > 0))
    df = df.withColumn(
        "_score", F.when(active, F.least(bounded, F.lit(IMPERSONATION_CAP))).otherwise(bounded)
    )
    named = F.when(
        brand["kind"] == "lookalike",
        F.concat(F.lit("Spelled to resemble "), brand["brand"], F.lit(".")),
    ).otherwise(F.concat(F.lit("Uses the name "), brand["brand"], F.lit(" on a domain it does not own.")))
    threat = F.coalesce(first(F.col("threats")), F.lit("a known threat"))
    reasons = compact(
        F.when(listed.isNull(), _reason("safe_browsing", F.lit("The threat list was not checked."), "unknown"))
        .when(listed, _reason("safe_browsing", F.concat(F.lit("Listed for "), threat, F.lit(".")), "bad"))
        .otherwise(_reason("safe_browsing", F.lit("Not on the threat list."), "good")),
        F.when(bad_brand, _reason("brand", named, "bad")),
        F.when(
            bad_brand & (F.size(lures) > 0),
            _reason("brand", F.concat(F.lit("Carries the lure word "), first(lures), F.lit(".")), "bad"),
        ),
        _age_reason(days),
    )
    listed_reasons = F.slice(reasons, 1, 1)
    no_host = F.col("host") == ""
    hit = F.coalesce(listed, F.lit(False))
    df = df.withColumn(
        "reasons",
        F.when(no_host, F.array(_reason("input", F.lit("The address could not be read."), "unknown")))
        .when(hit, listed_reasons)
        .otherwise(reasons),
    )
    df = settle(df, ["_available", "_score", "reasons"])
    score = F.col("_score")
    any_bad = F.exists("reasons", lambda r: r["weight"] == "bad")
    verdict = (
        F.when(no_host, "unknown")
        .when(hit, "dangerous")
        .when(score < 40, "dangerous")
        .when(F.col("_available") < MIN_WEIGHT, "unknown")
        .when((score < 75) | any_bad, "suspicious")
        .otherwise("safe")
    )
    df = df.withColumn("verdict", verdict)
    final = (
        F.when(no_host, F.lit(0)).when(hit, F.lit(2))
        .when(F.col("verdict") == "unknown", F.least(score, F.lit(50)))
        .otherwise(score)
    )
    confidence = (
        F.when(no_host, 0.0).when(hit, 0.99).otherwise(F.round(F.col("_available") / F.lit(1.0), 2))
    )
    unknown_left = F.exists("reasons", lambda r: r["weight"] == "unknown")
    summary = (
        F.when(hit, "Leave this site: it is on a list of known attacks.")
        .when(F.col("verdict") == "dangerous", "Looks like a scam. Enter nothing personal here.")
        .when(F.col("verdict") == "suspicious", "Take care: something about this site is off.")
        .when(F.col("verdict") == "unknown", "Could not be checked. That does not make it safe.")
        .when(unknown_left, "Nothing found, but a check is missing.")
        .otherwise("Nothing found.")
    )
    return (
        df.withColumn("trust_score", final)
        .withColumn("confidence", confidence)
        .withColumn("summary", summary)
        .withColumn("brand_mismatch", bad_brand & ~hit & ~no_host)
        .withColumn("domain_age_days", F.when(~hit, days))
        .withColumn("safe_browsing_hit", listed)
        .drop("_available", "_penalty", "_score")
    )


def score_distinct_urls(urls: DataFrame, now: Column, url_col: str = "url", **tables) -> DataFrame:
    """Score each reuse key once and join the verdict back to every row.

    Worth its two shuffles when the list and registry joins dominate; a hot key on
    the row side is split by the adaptive skew join.
    """
    keyed = parse_urls(urls, url_col)
    return keyed.join(_key_verdicts(keyed, now, url_col, tables), "url_key", "left")


def _key_verdicts(keyed: DataFrame, now: Column, url_col: str, tables: dict) -> DataFrame:
    one = keyed.groupBy("url_key").agg(F.min(url_col).alias("_url"))
    return score_urls(one, now, url_col="_url", **tables).select(
        "url_key", "trust_score", "verdict", "reasons", "confidence", "summary",
        "brand_mismatch", "domain_age_days", "safe_browsing_hit",
    )


def missing_verdicts(
    urls: DataFrame, live: DataFrame, now: Column, hours: float = REUSE_HOURS, url_col: str = "url", **tables
) -> DataFrame:
    """Verdicts of the reuse keys that ``live`` lacks, each scored once, as rows for the ledger.

    The keys are taken away before anything is looked up, so what is reused costs a join on
    narrow rows.  A URL that cannot be read has the key that ``parse_urls`` gives it; a NULL one has none
    and gets no verdict.
    """
    new = parse_urls(urls, url_col).join(live.select("url_key"), "url_key", "left_anti")
    until = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600).cast("decimal(18,6)"))
    scored = _key_verdicts(new.filter("url_key IS NOT NULL"), now, url_col, tables)
    return scored.withColumns({
        "trust_score": F.col("trust_score").cast("int"), "checked_at": now, "valid_until": until,
    })


def with_verdicts(urls: DataFrame, live: DataFrame, now: Column, url_col: str = "url") -> DataFrame:
    """Every row with the verdict of its key, and whether that is from an earlier run."""
    return parse_urls(urls, url_col).join(live, "url_key", "left").withColumn("reused", F.col("checked_at") < now)


def storable_checks(scored: DataFrame) -> DataFrame:
    """The rows worth keeping as site checks: a domain, and not safe."""
    return scored.filter((F.col("verdict") != "safe") & (F.col("domain") != ""))
