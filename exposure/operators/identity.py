"""Breach analytics over hash prefixes; no password and no full hash of a user is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure import dims
from exposure.functions.basics import plural


def valid_prefix(prefix: Column) -> Column:
    """Upper-cased five-digit hex prefix, NULL if it is not one."""
    clean = F.upper(F.trim(prefix))
    return F.when(clean.rlike("^[0-9A-F]{5}$"), clean)


def range_lookup(prefixes: DataFrame, corpus: DataFrame, prefix_col: str = "hash_prefix") -> DataFrame:
    """All suffixes and counts of the asked prefixes: the client matches its own suffix.

    The asked prefixes are made distinct first, so a hot prefix ships its range once.
    """
    asked = (
        prefixes.select(valid_prefix(F.col(prefix_col)).alias("prefix"))
        .filter(F.col("prefix").isNotNull())
        .distinct()
    )
    return asked.join(corpus, "prefix").select("prefix", "suffix", "count")


def match_own(secrets: DataFrame, corpus: DataFrame, secret_col: str = "secret", in_place: bool = False) -> DataFrame:
    """Own-side batch match: breach count of each secret, 0 if its range lacks it.

    ``breach_count`` is NULL where the corpus holds no range for the prefix.  Secrets are
    reduced to distinct digests before the joins, and the secret itself is dropped.

    ``in_place``: the corpus is bucketed by prefix.  The distinct digests are then dealt by prefix as
    their last step, which makes Spark take the buckets' partitioning and never move the corpus.
    """
    digest = F.upper(F.sha1(F.col(secret_col).cast("binary")))
    hashed = secrets.withColumn("prefix", F.substring(digest, 1, 5)).withColumn(
        "suffix", F.substr(digest, F.lit(6))
    ).drop(secret_col)
    keys = hashed.select("prefix", "suffix").distinct()
    if in_place:
        keys = keys.repartition("prefix")
    loaded = corpus.select("prefix").distinct().withColumn("loaded", F.lit(True))
    found = (
        keys.join(corpus, ["prefix", "suffix"], "left")
        .join(loaded, "prefix", "left")
        .select("prefix", "suffix", F.when(F.col("loaded"), F.coalesce("count", F.lit(0))).alias("breach_count"))
    )
    return hashed.join(found, ["prefix", "suffix"], "left")


def k_anonymity(corpus: DataFrame) -> DataFrame:
    """How many hashes share each prefix: the crowd one lookup hides in."""
    return corpus.groupBy("prefix").agg(
        F.count("*").alias("suffixes"), F.max("count").alias("max_count")
    )


def plausible(checks: DataFrame, corpus: DataFrame) -> DataFrame:
    """Does some suffix of the range carry the reported count?  NULL: could not check."""
    pairs = corpus.select("prefix", F.col("count").alias("breach_count")).distinct().withColumn(
        "_pair", F.lit(True)
    )
    loaded = corpus.select("prefix").distinct().withColumn("_loaded", F.lit(True))
    asked = checks.withColumn("prefix", valid_prefix(F.col("hash_prefix")))
    return (
        asked.join(loaded, "prefix", "left")
        .join(pairs, ["prefix", "breach_count"], "left")
        .withColumn(
            "verified",
            F.when(
                F.col("_loaded") & (F.col("breach_count") > 0),
                F.coalesce("_pair", F.lit(False)),
            ),
        )
        .drop("_pair", "_loaded", "prefix")
    )


def band(count: Column, what: int) -> Column:
    """Field ``what`` of the breach band of a count: 1 penalty, 2 level."""
    out = None
    for row in dims.BREACH_BANDS:
        test = count >= row[0]
        out = F.when(test, F.lit(row[what])) if out is None else out.when(test, F.lit(row[what]))
    return out.otherwise(F.lit((None, 0.0, "low")[what]))


def rate(checks: DataFrame) -> DataFrame:
    """Add penalty, level, confidence and reason; ``verified`` may be absent or NULL."""
    count = F.greatest(F.coalesce(F.col("breach_count"), F.lit(0)), F.lit(0))
    doubted = (
        F.coalesce(F.col("verified") == F.lit(False), F.lit(False))
        if "verified" in checks.columns
        else F.lit(False)
    )
    reason = F.when(count > 0, F.concat(
        F.lit("Seen in "), F.format_number(count, 0), plural(count, " breached account", " breached accounts")
    )).otherwise("Not seen in the breach corpus")
    return (
        checks.withColumn("penalty", band(count, 1))
        .withColumn("risk_level", band(count, 2))
        .withColumn("confidence", F.when((count > 0) & doubted, 0.75).otherwise(0.95))
        .withColumn("reason", reason)
    )


def dedupe_key() -> Column:
    label = F.col("label")
    return F.when(
        F.coalesce(label, F.lit("")) != "", F.concat(F.lit("label:"), F.trim(F.lower(label)))
    ).otherwise(F.concat(F.lit("prefix:"), F.col("hash_prefix")))


def live_checks(checks: DataFrame) -> DataFrame:
    """Newest check of each password of each device.  Partial aggregation, no window."""
    newest = F.max(F.struct("occurred_at", "id", "breach_count", "label", "hash_prefix"))
    return (
        checks.groupBy("device_id", dedupe_key().alias("key"))
        .agg(newest.alias("n"), F.min(F.struct("occurred_at", "id")).alias("first_seen"))
        .select(
            "device_id", "key", "first_seen", F.col("n.occurred_at"), F.col("n.id"),
            F.col("n.breach_count"), F.col("n.label"), F.col("n.hash_prefix"),
            band(F.col("n.breach_count"), 1).alias("penalty"),
            band(F.col("n.breach_count"), 2).alias("risk_level"),
        )
    )


def breached_names(live: DataFrame) -> DataFrame:
    """All breached passwords of each device by first sight, as an array."""
    order = Window.partitionBy("device_id").orderBy("first_seen", "key")
    return (
        live.filter(F.col("breach_count") > 0)
        .withColumn("rn", F.row_number().over(order))
        .groupBy("device_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rn", F.coalesce("label", F.lit("One of your passwords")).alias("label")))
            ).alias("first_breached")
        )
    )


def identity_totals(live: DataFrame) -> DataFrame:
    """Penalty and counts per device; a device without checks has no row, not a zero."""
    return live.groupBy("device_id").agg(
        F.sum("penalty").alias("i_penalty"),
        F.count("*").alias("i_checked"),
        F.count_if(F.col("breach_count") > 0).alias("i_breached"),
    )


def identity_detail(checked: Column, breached: Column) -> Column:
    return (
        F.when(checked.isNull(), "No password has been checked, so this part is missing.")
        .when(
            breached == 0,
            F.concat(checked.cast("string"), plural(checked, " password", " passwords"), F.lit(" checked, none breached.")),
        )
        .otherwise(
            F.concat(
                breached.cast("string"), F.lit(" of "), checked.cast("string"),
                plural(checked, " password", " passwords"), F.lit(" found in breaches."),
            )
        )
    )
