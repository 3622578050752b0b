"""Device scores from sums per device and day, kept next to the event tables and refreshed by day.

Penalties fade exponentially, so a day's events age together: one number per device and day, faded to
the day's end, stands for them at any later time.  Of site checks, the worst per device, domain and day
is kept.  Both tables are partitioned by day like the events.

``refresh`` reads the days whose event files have changed and rewrites their partitions alone;
a ledger of the files seen is kept beside the sums, and only names of files and days are compared.
``scores`` reads the sums of the look-back's whole days, and events of two kinds of day only: the one
that the look-back's edge cuts, and those that are not over at ``now``.  The scores are those of
:func:`exposure.operators.risk.risk_scores`.

A run that is lost leaves the ledger as it was, and the next run does its days again.  Days may gain
files or be compacted; a day whose files are all taken away keeps its sums.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from exposure import dims
from exposure.functions.basics import pick
from exposure.operators import risk
from exposure.sources.tables import PII_EVENTS, SITE_CHECKS

KINDS = {"pii": PII_EVENTS, "site": SITE_CHECKS}
SUMS = {
    "pii": "device_id STRING, edge BOOLEAN, p DOUBLE, n BIGINT, event_date DATE",
    "site": "device_id STRING, domain STRING, edge BOOLEAN, base DOUBLE, occurred_at TIMESTAMP, visits BIGINT, event_date DATE",
}
FILES = "file STRING, event_date DATE"


def _day_end(day: str = "event_date") -> Column:
    return F.date_add(day, 1).cast("timestamp")


def _on_edge() -> Column:
    """At midnight: inside both of the windows that meet there."""
    return F.col("occurred_at") == F.col("event_date").cast("timestamp")


def sum_pii(events: DataFrame) -> DataFrame:
    """Penalty of each device and day, faded to the day's end."""
    return events.groupBy("device_id", "event_date", _on_edge().alias("edge")).agg(
        F.sum(risk.pii_penalty(_day_end())).alias("p"), F.count("*").alias("n")
    )


def sum_site(checks: DataFrame) -> DataFrame:
    """The worst check of each device, domain and day, the latest of equals."""
    base = pick(dims.SITE_BASE_PENALTY, F.col("verdict"), 0.0)
    return (
        checks.groupBy("device_id", "domain", "event_date", _on_edge().alias("edge"))
        .agg(F.max(F.struct(base.alias("base"), "occurred_at")).alias("w"), F.count("*").alias("visits"))
        .select("device_id", "domain", "event_date", "edge", "w.base", "w.occurred_at", "visits")
    )


_SUMMED = {"pii": sum_pii, "site": sum_site}


def _files(spark: SparkSession, path: str) -> DataFrame:
    """A row per file of an event table.  Files are listed, not opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    day = F.regexp_extract("path", "event_date=([0-9-]+)", 1)
    return listed.select(
        day.try_cast("date").alias("event_date"), F.concat_ws(" ", "path", F.col("modificationTime").cast("string"), "length").alias("file")
    ).filter("event_date IS NOT NULL")


def start(spark: SparkSession, base: str) -> None:
    """Empty sums and ledgers."""
    for kind, schema in SUMS.items():
        spark.createDataFrame([], schema).write.partitionBy("event_date").parquet(f"{base}/{kind}")
        spark.createDataFrame([], FILES).write.partitionBy("event_date").parquet(f"{base}/{kind}_files")


def _write_days(df: DataFrame, path: str) -> None:
    (
        df.repartition("event_date", F.pmod(F.xxhash64(df.columns[0]), F.lit(16)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    )


def refresh(spark: SparkSession, base: str, paths: dict[str, str]) -> dict[str, list[dt.date]]:
    """Bring the sums of changed days up to date; the days that were read, per kind of event.

    ``paths`` has the event tables ``pii`` and ``site``.  The days reach the driver, the rows do not.
    """
    done = {}
    for kind, path in paths.items():
        there, seen = _files(spark, path), spark.read.schema(FILES).parquet(f"{base}/{kind}_files")
        changed = there.select("file", "event_date").exceptAll(seen).union(seen.exceptAll(there.select("file", "event_date"))).select("event_date").distinct()
        done[kind] = days = sorted(r.event_date for r in changed.collect())
        if days:
            read_now = F.col("event_date").isin(days)
            events = spark.read.schema(KINDS[kind]).parquet(path).filter(read_now)
            _write_days(_SUMMED[kind](events).select(*StructType.fromDDL(SUMS[kind]).fieldNames()), f"{base}/{kind}")
            _write_days(there.filter(read_now).select("file", "event_date"), f"{base}/{kind}_files")
    return done


def _parts(spark: SparkSession, base: str, paths: dict[str, str], kind: str, now: Column) -> DataFrame:
    """Sums of the look-back's whole days, and sums made now of the days that it cuts."""
    since = now - F.expr(f"INTERVAL {dims.LOOKBACK_DAYS} DAYS")
    day = F.col("event_date")
    whole = spark.read.schema(SUMS[kind]).parquet(f"{base}/{kind}").filter((day > F.to_date(since)) & (day < F.to_date(now)))
    cut = spark.read.schema(KINDS[kind]).parquet(paths[kind]).filter(
        ((day == F.to_date(since)) | (day >= F.to_date(now))) & risk.in_window(F.col("occurred_at"), now)
    )
    if kind == "pii":
        fresh = cut.groupBy("device_id").agg(F.sum(risk.pii_penalty(now)).alias("p"))
        faded = F.col("p") * F.pow(F.lit(0.5), risk.age_days(_day_end(), now) / dims.HALF_LIFE_DAYS)
        return whole.select("device_id", faded.alias("p")).unionByName(fresh)
    kept = ["device_id", "domain", "base", "occurred_at"]
    return whole.select(*kept).unionByName(sum_site(cut).select(*kept))


def scores(spark: SparkSession, base: str, paths: dict[str, str], now: Column) -> DataFrame:
    """``device_id, privacy, browsing`` at ``now``, a row per device that has ever had an event."""
    privacy = _parts(spark, base, paths, "pii", now).groupBy("device_id").agg(F.sum("p").alias("e_p"))
    worst = (
        _parts(spark, base, paths, "site", now).groupBy("device_id", "domain")
        .agg(F.max(F.struct("base", "occurred_at")).alias("w"))
    )
    browsing = worst.groupBy("device_id").agg(
        F.sum(F.col("w.base") * risk.decay(F.col("w.occurred_at"), now)).alias("s_p")
    )
    everyone = [spark.read.schema(SUMS[k]).parquet(f"{base}/{k}").select("device_id").distinct() for k in SUMS]
    merged = privacy.unionByName(browsing, allowMissingColumns=True)
    for part in everyone:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.groupBy("device_id").agg(
        risk.curve(F.coalesce(F.max("e_p"), F.lit(0.0))).alias("privacy"),
        risk.curve(F.coalesce(F.max("s_p"), F.lit(0.0))).alias("browsing"),
    )


def replay_daily(spark: SparkSession, base: str, now: dt.date, days: int = 30) -> DataFrame:
    """:func:`exposure.operators.risk.replay_daily` for the midnights up to that of ``now``, from the sums alone."""
    lookback, at = dims.LOOKBACK_DAYS, F.lit(now)
    # whole days between a bucket's end and the midnight of now; a midnight event counts from that midnight on
    age = F.datediff(at, "event_date") - 1
    first = F.greatest(F.lit(0), age - lookback + 1)
    last = F.least(F.lit(days), F.when(F.col("edge"), age + 1).otherwise(age))
    seen_on = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def read(kind: str) -> DataFrame:
        since = F.date_sub(at, days + lookback + 1)
        stored = spark.read.schema(SUMS[kind]).parquet(f"{base}/{kind}").filter(F.col("event_date").between(since, at))
        return stored.withColumn("d", F.explode(seen_on)).withColumn("as_of", F.date_sub(at, F.col("d")).cast("timestamp"))

    privacy = read("pii").groupBy("device_id", "d").agg(
        F.sum(F.col("p") * F.pow(F.lit(0.5), risk.age_days(_day_end(), F.col("as_of")) / dims.HALF_LIFE_DAYS)).alias("e_p")
    )
    browsing = (
        read("site").filter("base > 0").groupBy("device_id", "d", "as_of", "domain")
        .agg(F.max(F.struct("base", "occurred_at")).alias("w")).groupBy("device_id", "d")
        .agg(F.sum(F.col("w.base") * risk.decay(F.col("w.occurred_at"), F.col("as_of"))).alias("s_p"))
    )
    everyone = [spark.read.schema(SUMS[k]).parquet(f"{base}/{k}").select("device_id").distinct() for k in SUMS]
    merged = everyone[0].union(everyone[1]).distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(days))))
    for part in (privacy, browsing):
        merged = merged.unionByName(part, allowMissingColumns=True)
    none = F.lit(None).cast("int")
    return (
        merged.groupBy("device_id", "d").agg(F.sum("e_p").alias("e_p"), F.sum("s_p").alias("s_p"))
        .select(
            "device_id", F.date_sub(at, F.col("d")).cast("timestamp").alias("captured_at"),
            risk.curve(F.coalesce("e_p", F.lit(0.0))).alias("privacy"),
            risk.curve(F.coalesce("s_p", F.lit(0.0))).alias("browsing"),
        )
        .withColumn("overall", risk.overall(F.col("privacy"), F.col("browsing"), none))
    )
