"""Timelines, flagged sites, score trends and the per-device summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure import dims
from exposure.functions.basics import first, pick, plural, settle
from exposure.operators import identity as ident
from exposure.operators.narrative import narrative
from exposure.operators.risk import (
    add_scores, bare_host, device_totals, headline, in_window, recommendation_array,
)

REASONS = "array<struct<signal:string,detail:string,weight:string>>"


def device_table(*tables: DataFrame) -> DataFrame:
    """First and last sight of each device over (``device_id, occurred_at``) tables."""
    merged = None
    for t in tables:
        part = t.select("device_id", "occurred_at")
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy("device_id").agg(
        F.min("occurred_at").alias("created_at"), F.max("occurred_at").alias("last_seen_at")
    )


def latest_device(devices: DataFrame) -> DataFrame:
    """The most recently active device: a global top-1, no full sort."""
    return devices.orderBy(F.desc("last_seen_at"), "device_id").limit(1)


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _timeline_rows(events: DataFrame, checks: DataFrame, identity_checks: DataFrame) -> DataFrame:
    site = bare_host(F.col("site_origin"))
    label = F.coalesce(
        pick(dims.PII_TITLES, F.col("pii_type")), F.initcap(F.replace("pii_type", F.lit("_"), F.lit(" ")))
    )
    verb = F.when(F.col("field_kind") == "paste", " pasted on ").when(
        F.col("field_kind") == "image", " in an image on "
    ).otherwise(" typed on ")
    pii = events.select(
        "device_id", "occurred_at", F.lit(0).alias("ord"), "id", F.lit("pii").alias("kind"),
        _say(label, verb, site).alias("title"), F.col("reason").alias("detail"),
        F.col("risk_level").alias("severity"), "masked_preview", site.alias("site"),
    )
    severity = {"dangerous": "critical", "suspicious": "medium"}
    why = F.nullif(first(F.col("reasons"))["detail"], F.lit(""))
    site_rows = checks.select(
        "device_id", "occurred_at", F.lit(1).alias("ord"), "id", F.lit("site").alias("kind"),
        _say(F.col("domain"), " rated ", F.col("verdict")).alias("title"),
        F.coalesce(why, _say("Trust ", F.col("trust_score").cast("string"), " of 100")).alias("detail"),
        pick(severity, F.col("verdict"), "low").alias("severity"),
        F.lit(None).cast("string").alias("masked_preview"), F.col("domain").alias("site"),
    )
    who = F.coalesce(F.nullif("label", F.lit("")), F.lit("A password"))
    n = F.col("breach_count")
    ids = identity_checks.select(
        "device_id", "occurred_at", F.lit(2).alias("ord"), "id", F.lit("identity").alias("kind"),
        F.when(n > 0, _say(who, ": in ", F.format_number(n, 0), plural(n, " breached account", " breached accounts")))
        .otherwise(_say(who, ": in no breach")).alias("title"),
        F.col("reason").alias("detail"), F.col("risk_level").alias("severity"),
        F.lit(None).cast("string").alias("masked_preview"), F.lit(None).cast("string").alias("site"),
    )
    return pii.unionByName(site_rows).unionByName(ids)


def timeline(
    events: DataFrame, checks: DataFrame, identity_checks: DataFrame, now: Column, k: int = 25
) -> DataFrame:
    """Newest ``k`` of the three kinds of events per device.

    ``row_number() <= k`` is applied before the shuffle as well, so a device with a
    third of all rows sends ``k`` rows per task.
    """
    rows = _timeline_rows(
        events.filter(in_window(F.col("occurred_at"), now)),
        checks.filter(in_window(F.col("occurred_at"), now)),
        identity_checks,
    )
    order = Window.partitionBy("device_id").orderBy(F.desc("occurred_at"), "ord", F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("ord", "id")


def flagged_sites(checks: DataFrame, now: Column, k: int = 10) -> DataFrame:
    """Per device the worst ``k`` domains: worst verdict, lowest trust, visits, newest reasons."""
    rank = pick(dims.VERDICT_RANK, F.col("verdict"), 0)
    told = F.when(F.size("reasons") > 0, F.struct("occurred_at", "id", "reasons"))
    sites = (
        checks.filter(in_window(F.col("occurred_at"), now) & (F.col("verdict") != "safe"))
        .withColumn("vr", rank)
        .groupBy("device_id", "domain")
        .agg(
            F.max("vr").alias("vr"),
            F.min("trust_score").alias("trust_score"),
            F.max("occurred_at").alias("last_seen"),
            F.count("*").alias("visits"),
            F.max(told)["reasons"].alias("reasons"),
        )
    )
    names = {v: k for k, v in dims.VERDICT_RANK.items()}
    order = Window.partitionBy("device_id").orderBy(
        F.desc("vr"), "trust_score", F.desc("visits"), F.desc("last_seen"), "domain"
    )
    return (
        sites.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(
            "device_id", "rank", "domain", pick(names, F.col("vr")).alias("verdict"),
            "trust_score", "last_seen", "visits",
            F.coalesce("reasons", F.array().cast(REASONS)).alias("reasons"),
        )
    )


def headline_reasons(reasons: Column) -> Column:
    """At most three reasons that are not good news."""
    return F.slice(F.filter(reasons, lambda r: r["weight"] != "good"), 1, 3)


def trend(snapshots: DataFrame, now: Column) -> DataFrame:
    return snapshots.filter(in_window(F.col("captured_at"), now))


# ---------------------------------------------------------------------------
# Snapshot thinning
# ---------------------------------------------------------------------------


#: gaps per slice of a device's time; a chain keeps at most one time per gap
SLICE_GAPS = 16


def _followed(start: Column, jumps: Column, size: Column) -> Column:
    """Places of a chain from ``start``, in order: ``jumps`` leads from each place to the next, to ``size`` at its end.

    By doubling: each round joins to the places known so far those that many jumps further on,
    and squares the jumps, so a chain of n places takes log2(n) rounds over the array.
    """
    closed = F.concat(jumps, F.array(size))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(size + 1)).cast("int")))
    state = "struct<j:array<int>,l:array<int>>"

    def double(acc: Column, _: Column) -> Column:
        j, known = acc["j"], acc["l"]
        return F.struct(
            F.transform(j, lambda x: F.get(j, x)).alias("j"),
            F.concat(known, F.transform(known, lambda x: F.get(j, x))).alias("l"),
        ).cast(state)

    first_place = F.struct(closed.alias("j"), F.array(start).alias("l")).cast(state)
    return F.aggregate(rounds, first_place, double, lambda acc: F.filter(acc["l"], lambda x: x < size))


def thin_snapshots(snapshots: DataFrame, minutes: int = 5) -> DataFrame:
    """Keep a snapshot only if at least ``minutes`` passed since the last kept one.

    The greedy rule is sequential, so it becomes a search for what a table of successors reaches
    (a time's successor is the first one at least the gap later):

    1. Device and time are cut into slices of 16 gaps.  A window gives each time its successor within
       the slice, and four squarings of the successors give the time at which a chain entering there
       leaves.  Only times within one gap of the slice's start, and the first after them, can be entries;
       those that leave alike are one step.
    2. The few steps of a device follow one another in the same way, by doubling; this tells from which time
       on each slice is entered.
    3. Each slice follows its own chain from there.

    A device's rows lie in as many tasks as it has slices; one task holds the distinct times of a slice, or the
    steps of a device.  Rows without device or time are left out; of rows of equal device and time one stays.
    """
    gap = minutes * 60_000_000
    width = SLICE_GAPS * gap
    time = F.unix_micros("captured_at")
    begin = time - F.pmod(time, F.lit(width))
    # stated here, as joins would add it for some readers only and split the exchange
    placed = snapshots.filter(F.col("device_id").isNotNull() & F.col("captured_at").isNotNull() & begin.isNotNull())
    slim = placed.select("device_id", begin.alias("_slice"), time.alias("_t")).repartition("device_id", "_slice").distinct()
    near = Window.partitionBy("device_id", "_slice").orderBy("_t").rangeBetween(Window.unboundedPreceding, gap - 1)
    runs = (
        slim.withColumn("_next", F.count("*").over(near).cast("int"))
        .groupBy("device_id", "_slice")
        .agg(F.array_sort(F.collect_list(F.struct("_t", "_next"))).alias("_run"))
        .select(
            "device_id", "_slice", F.transform("_run", lambda x: x["_t"]).alias("_times"),
            F.transform("_run", lambda x: x["_next"]).alias("_next"), F.size("_run").alias("_n"),
        )
    )
    steps = _exits(runs, gap)
    entered = _entered(steps, gap, width)
    chain = runs.join(entered, ["device_id", "_slice"])
    start = F.size(F.filter("_times", lambda t: t < F.col("_from")))
    places = settle(chain.withColumn("_at", _followed(start, F.col("_next"), F.col("_n"))), ["_at"])
    kept = places.select("device_id", "_slice", F.transform("_at", lambda i: F.get("_times", i)).alias("_kept"))
    rows = placed.select("device_id", begin.alias("_slice"), F.struct(*[c for c in snapshots.columns if c != "device_id"]).alias("_r"))
    held = rows.join(kept, ["device_id", "_slice"]).withColumn("_t", F.unix_micros("_r.captured_at"))
    one = held.filter(F.array_contains("_kept", F.col("_t"))).groupBy("device_id", "_slice", "_t").agg(F.min("_r").alias("_r"))
    return one.select("device_id", "_r.*")


def _exits(runs: DataFrame, gap: int) -> DataFrame:
    """``(device_id, until, leave)``: a chain that enters a slice at ``until`` or less, but after the step before, leaves at ``leave``."""
    last = settle(runs.withColumn("_last", F.transform("_next", lambda x, i: F.when(x < F.col("_n"), x).otherwise(i))), ["_last"])
    for _ in range(SLICE_GAPS.bit_length() - 1):
        last = settle(last.withColumn("_last", F.transform("_last", lambda i: F.get("_last", i))), ["_last"])
    entries = 1 + F.size(F.filter("_times", lambda t: t < F.col("_slice") + gap))
    last = settle(last.withColumn("_ways", F.slice("_last", F.lit(1), entries)), ["_ways"])
    step = F.transform("_ways", lambda end, i: F.when(
        F.coalesce(F.get("_ways", i + 1) != end, F.lit(True)),
        F.struct(F.get("_times", i).alias("until"), F.get("_times", end).alias("leave")),
    ))
    return last.select("device_id", F.explode(F.filter(step, lambda x: x.isNotNull())).alias("s")).select("device_id", "s.*")


def _entered(steps: DataFrame, gap: int, width: int) -> DataFrame:
    """``(device_id, _slice, _from)``: the chain of the device takes the first time of the slice from ``_from`` on."""
    marks = steps.select("device_id", F.inline(F.array(
        F.struct(F.col("until").alias("at"), F.lit(1).alias("step"), "until", "leave"),
        F.struct((F.col("leave") + gap).alias("at"), F.lit(0).alias("step"), "until", "leave"),
    )))
    # steps before the place where a chain that has left goes on; at equal times that place comes first
    before = Window.partitionBy("device_id").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    per_device = (
        marks.withColumn("next", F.sum("step").over(before).cast("int")).filter("step = 0")
        .groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("until", "leave", "next"))).alias("s"))
    )
    reached = _followed(F.lit(0), F.transform("s", lambda x: x["next"]), F.size("s"))
    path = settle(per_device.select("device_id", F.transform(reached, lambda i: F.get("s", i)["leave"]).alias("left")), ["left"])
    begun = F.transform("left", lambda leave, k: F.struct(
        (leave - F.pmod(leave, F.lit(width))).alias("_slice"),
        F.when(k > 0, F.get("left", k - 1) + gap).otherwise(F.lit(-(2**62))).alias("_from"),
    ))
    return path.select("device_id", F.inline(begun))


# ---------------------------------------------------------------------------
# Summary
# ---------------------------------------------------------------------------


def summary(
    events: DataFrame, checks: DataFrame, identity_checks: DataFrame, now: Column
) -> DataFrame:
    """One row per device with everything a dashboard shows.

    Every array is bounded: 4 drivers, 4 pieces of advice, 25 timeline rows, 10 sites.
    """
    live = ident.live_checks(identity_checks)
    told = narrative(add_scores(device_totals(events, checks, identity_checks, now)), live)
    lines = timeline(events, checks, identity_checks, now)
    line_cols = [c for c in lines.columns if c not in ("device_id", "rank")]
    per_line = lines.groupBy("device_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *line_cols))).alias("timeline")
    )
    sites = flagged_sites(checks, now).withColumn("reasons", headline_reasons(F.col("reasons")))
    site_cols = [c for c in sites.columns if c not in ("device_id", "rank")]
    per_site = sites.groupBy("device_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *site_cols))).alias("flagged_sites")
    )
    base = told.select(
        "device_id", "overall", "risk_level", headline().alias("headline"), "confidence",
        "privacy", "browsing", "identity", "coverage", "story", "drivers",
        F.col("best.code").alias("lever"), recommendation_array().alias("recommendations"),
        F.col("e_n").alias("total_pii_events"), F.col("e_n_masked").alias("total_masked"),
        (F.col("s_n_dangerous") + F.col("s_n_suspicious")).alias("total_sites_flagged"),
        F.lit(dims.LOOKBACK_DAYS).alias("window_days"),
    )
    return base.join(per_line, "device_id", "left").join(per_site, "device_id", "left")
