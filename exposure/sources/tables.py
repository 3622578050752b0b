"""Readers and writers of the stored tables.

Event tables are Parquet partitioned by ``event_date``; a look-back becomes a partition
filter next to the exact time filter, so old days are never listed or read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from exposure import dims
from exposure.operators.pii import explode_findings
from exposure.operators.urls import storable_checks

PII_EVENTS = (
    "id BIGINT, device_id STRING, occurred_at TIMESTAMP, site_origin STRING, field_kind STRING, pii_type STRING, "
    "risk_level STRING, confidence DOUBLE, detection_tier STRING, reason STRING, masked_preview STRING, "
    "action_taken STRING, event_date DATE"
)
SITE_CHECKS = (
    "id BIGINT, device_id STRING, occurred_at TIMESTAMP, domain STRING, trust_score INT, verdict STRING, "
    "reasons ARRAY<STRUCT<signal:STRING,detail:STRING,weight:STRING>>, domain_age_days INT, "
    "safe_browsing_hit BOOLEAN, brand_mismatch BOOLEAN, event_date DATE"
)
IDENTITY_CHECKS = (
    "id BIGINT, device_id STRING, occurred_at TIMESTAMP, hash_prefix STRING, label STRING, breach_count BIGINT, "
    "risk_level STRING, confidence DOUBLE, reason STRING, event_date DATE"
)
SNAPSHOTS = "device_id STRING, captured_at TIMESTAMP, overall INT, privacy INT, identity INT, browsing INT, event_date DATE"

VERDICTS = (
    "url_key STRING, trust_score INT, verdict STRING, "
    "reasons ARRAY<STRUCT<signal:STRING,detail:STRING,weight:STRING>>, confidence DOUBLE, summary STRING, "
    "brand_mismatch BOOLEAN, domain_age_days INT, safe_browsing_hit BOOLEAN, checked_at TIMESTAMP, "
    "valid_until TIMESTAMP, valid_day DATE"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, split as ``spark.sql.files.maxPartitionBytes`` says."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_events(
    spark: SparkSession, path: str, now: Column, schema: str | StructType = PII_EVENTS,
    days: int = dims.LOOKBACK_DAYS, device_id: str | None = None,
) -> DataFrame:
    """Events of the look-back window, of one or all devices."""
    since = now - F.expr(f"INTERVAL {days} DAYS")
    df = spark.read.schema(schema).parquet(path).filter(
        (F.col("event_date") >= F.to_date(since)) & (F.col("occurred_at") >= since)
    )
    return df if device_id is None else df.filter(F.col("device_id") == device_id)


def read_identity(spark: SparkSession, path: str, device_id: str | None = None) -> DataFrame:
    """All password checks: identity has no window and no decay."""
    df = spark.read.schema(IDENTITY_CHECKS).parquet(path)
    return df if device_id is None else df.filter(F.col("device_id") == device_id)


def append_rows(df: DataFrame, path: str, schema: str, time_col: str = "occurred_at", spread: int = 64) -> None:
    """Append rows in stored form, by day.  Rows without an ``id`` get a hash of their content,
    and a column that they lack is NULL.

    A day's rows go to ``spread`` files by a hash of device and time, so a busy device is split.
    """
    fields = [f for f in StructType.fromDDL(schema).fields if f.name != "event_date"]
    df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in ("id", *df.columns)})
    if "id" not in df.columns and any(f.name == "id" for f in fields):
        df = df.withColumn("id", F.xxhash64(*[f.name for f in fields if f.name != "id"]))
    (
        df.select(*[F.col(f.name).cast(f.dataType) for f in fields], F.to_date(time_col).alias("event_date"))
        .repartition("event_date", F.pmod(F.xxhash64("device_id", time_col), F.lit(spread)))
        .sortWithinPartitions("event_date", "device_id", time_col)
        .write.mode("append").partitionBy("event_date").parquet(path)
    )


def findings_table(scanned: DataFrame) -> DataFrame:
    """Findings in stored form.  There is no column that could hold a raw match."""
    keep = ["device_id", "occurred_at", "site_origin", "field_kind"]
    return explode_findings(scanned, keep).select(
        *keep, "pii_type", "risk_level", "confidence", "detection_tier", "reason",
        "masked_preview", F.lit("none").alias("action_taken"),
    )


def write_findings(scanned: DataFrame, path: str) -> None:
    append_rows(findings_table(scanned), path, PII_EVENTS)


def site_checks_table(scored: DataFrame) -> DataFrame:
    return storable_checks(scored).select(
        "device_id", "occurred_at", "domain", "trust_score", "verdict", "reasons",
        "domain_age_days", "safe_browsing_hit", "brand_mismatch",
    )


def write_site_checks(scored: DataFrame, path: str) -> None:
    append_rows(site_checks_table(scored), path, SITE_CHECKS)


def identity_table(rated: DataFrame) -> DataFrame:
    return rated.select(
        "device_id", "occurred_at", F.upper("hash_prefix").alias("hash_prefix"), "label",
        "breach_count", "risk_level", "confidence", "reason",
    )


def write_identity(rated: DataFrame, path: str) -> None:
    append_rows(identity_table(rated), path, IDENTITY_CHECKS)


def write_snapshots(scores: DataFrame, captured_at: Column, path: str) -> None:
    """Keep the scores of this moment, a row per device."""
    append_rows(scores.withColumn("captured_at", captured_at), path, SNAPSHOTS, "captured_at")


def read_snapshots(spark: SparkSession, path: str, device_id: str | None = None) -> DataFrame:
    df = spark.read.schema(SNAPSHOTS).parquet(path)
    return df if device_id is None else df.filter(F.col("device_id") == device_id)


# ---------------------------------------------------------------------------
# Verdict ledger
# ---------------------------------------------------------------------------


def start_verdicts(spark: SparkSession, path: str) -> None:
    """An empty ledger."""
    spark.createDataFrame([], VERDICTS).write.partitionBy("valid_day").parquet(path)


def read_verdicts(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """The newest verdict of each key that still holds at ``now``; days that are over are not read."""
    live = spark.read.schema(VERDICTS).parquet(path).filter(
        (F.col("valid_day") >= F.to_date(now)) & (F.col("valid_until") > now) & (F.col("checked_at") <= now)
    )
    kept = [c for c in live.columns if c not in ("url_key", "valid_day")]
    newest = live.groupBy("url_key").agg(F.max_by(F.struct(*kept), F.struct("checked_at", "trust_score")).alias("v"))
    return newest.select("url_key", "v.*")


def append_verdicts(scored: DataFrame, path: str) -> None:
    """Add verdicts ``(url_key, .., checked_at, valid_until)``, by the day on which they end."""
    dated = scored.withColumn("valid_day", F.to_date("valid_until"))
    dated.select(*StructType.fromDDL(VERDICTS).fieldNames()).write.mode("append").partitionBy("valid_day").parquet(path)


def compact_verdicts(spark: SparkSession, path: str, into: str, now: Column) -> None:
    """Write the verdicts that still hold, one per key, to a new ledger."""
    start_verdicts(spark, into)
    append_verdicts(read_verdicts(spark, path, now), into)


def as_json(df: DataFrame, keep: list[str]) -> DataFrame:
    """Key columns and one JSON column with the whole row, for consumers of wire rows."""
    return df.select(*keep, F.to_json(F.struct(*df.columns)).alias("json"))
