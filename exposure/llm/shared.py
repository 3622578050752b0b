"""Folders and sizes that the corpus operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is missing, as in tests on one machine, it is a local one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="corpus-")
        base = _local[app]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, row_group_bytes: int | None = None) -> DataFrame:
    """Written once to the shared folder and read back: cuts lineage, survives lost executors.

    With ``row_group_bytes`` the writer looks at every row and starts a new row group there; by itself it
    looks at every hundredth, so a task that writes or reads rows of megabytes holds a hundred of them.
    """
    folder = shared_folder(df.sparkSession)
    writer = df.write
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size.row.check.min", 1)
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_megabytes(docs: DataFrame, text_col: str = "text") -> float:
    """Size of all texts: one pass that reads the text column alone."""
    total = docs.select(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"]
    return (total or 0) / 1e6


def sliced(docs: DataFrame, id_col: str, text_col: str, megabytes: float, long_text: int = 200_000) -> DataFrame:
    """``(slice, doc, text)``: rows dealt by a hash of their content into slices of some 2 MB.

    The slice of a row depends on the row alone, so a task that is run again deals alike.
    A long text is a slice by itself.
    """
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    n = max(64, math.ceil(megabytes / 2))
    own = F.octet_length(F.col(text_col)) > long_text
    place = F.when(own, F.shiftrightunsigned(row, 1) + n).otherwise(F.pmod(row, F.lit(n)))
    return docs.select(
        place.cast("long").alias("slice"), F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text")
    )
