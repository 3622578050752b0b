"""Breach corpora and knowledge cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_ranges(lines: DataFrame) -> DataFrame:
    """``prefix`` and ``line`` (``SUFFIX:COUNT``) to valid rows.

    Suffixes have 35 characters; a count of 0 is padding, not a password.  A suffix
    listed twice keeps its largest count.
    """
    parts = F.split("line", ":", 2)
    return (
        lines.select(
            F.upper(F.trim("prefix")).alias("prefix"),
            F.upper(F.trim(F.get(parts, F.lit(0)))).alias("suffix"),
            F.trim(F.get(parts, F.lit(1))).try_cast("bigint").alias("count"),
        )
        .filter((F.length("suffix") == 35) & (F.col("count") > 0))
        .groupBy("prefix", "suffix")
        .agg(F.max("count").alias("count"))
    )


def read_breach_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A folder of range files, each named by its five-digit prefix."""
    name = F.regexp_extract(F.input_file_name(), r"([0-9A-Fa-f]{5})(?:\.[a-z]+)?$", 1)
    return parse_ranges(spark.read.text(path).select(name.alias("prefix"), F.col("value").alias("line")))


def write_breach_corpus(corpus: DataFrame, table: str, buckets: int = 256) -> None:
    """A table bucketed by prefix, so joins on ranges need no shuffle of the corpus.

    Each bucket is one sorted file; take more buckets for a larger corpus.
    """
    dealt = corpus.repartition(buckets, "prefix").sortWithinPartitions("prefix", "suffix")
    dealt.write.bucketBy(buckets, "prefix").sortBy("prefix", "suffix").mode("overwrite").saveAsTable(table)


def read_buckets(spark: SparkSession, table: str) -> DataFrame:
    """A corpus as written above, whose joins on prefix and more stay where its buckets are.

    Without the setting below Spark would move both sides of a join that has more columns than the
    buckets; with it the other side alone is dealt by prefix.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(table)


def parse_cards(files: DataFrame) -> DataFrame:
    """``path`` and ``text`` of markdown files with front matter to knowledge cards."""
    text = F.concat(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\n"))
    has = text.rlike(r"^\s*---[ \t]*\n")
    front = r"(?s)^\s*---[ \t]*\n(.*?)\n?---[ \t]*\n"
    head = F.when(has, F.regexp_extract(text, front, 1)).otherwise("")
    body = F.when(has, F.regexp_replace(text, front + r"(.*)$", "$2")).otherwise(text)

    def field(name: str):
        found = F.regexp_extract(head, rf"(?m)^\s*{name}\s*:[ \t]*(.*?)[ \t]*$", 1)
        return F.nullif(F.btrim(found, F.lit("[]")), F.lit(""))

    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    title = F.coalesce(field("title"), F.initcap(F.replace(stem, F.lit("_"), F.lit(" "))))
    tags = F.filter(
        F.transform(F.split(F.coalesce(field("tags"), F.lit("")), ","), lambda t: F.trim(t)),
        lambda t: t != "",
    )
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    return files.select(
        F.coalesce(field("id"), stem).alias("id"), title.alias("title"), tags.alias("tags"),
        F.coalesce(field("summary"), title).alias("summary"), trimmed.alias("body"),
    )


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )
    return parse_cards(files)
