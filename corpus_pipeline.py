"""The corpus pipeline: what is kept of ``documents``, and where training reads it.

Five stages, each written as Parquet and read again before the next:

* ``quality``: documents that the classifier rejects go;
* ``lines``: lines that repeat an earlier one, up to one edit, are cut from the texts;
* ``near_duplicates``: of documents linked by shingle sets, the one with the smallest id stays,
  or one of them if none has an id;
* ``benchmark``: documents that hold a benchmark item go;
* ``mixing``: the source mix, a row per copy in training order.

A stage reads all that the one before kept, and all but the last return the columns of
``documents`` (``n_chars`` follows the text).  NULL and empty texts pass every filter but the
classifier's, and the mix takes no words of them.  Rows repeated whole count as one document
where documents are compared; a row with a NULL id is a document of its own and is judged like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm import quality
from exposure.llm.decontamination import find_leaks
from exposure.llm.jaccard_join import spare_rows
from exposure.llm.line_dedup import without_repeated_lines
from exposure.llm.mixing import mixed
from exposure.llm.shared import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).filter(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one."""
    return without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id; without ids, one of them."""
    spare = stored(spare_rows(docs).withColumnsRenamed({"row": "row_", "doc": "doc_"}))
    rows = docs.withColumn("row_", F.xxhash64("doc_id", "text"))
    listed = (rows["row_"] == spare["row_"]) & rows["doc_id"].eqNullSafe(spare["doc_"])
    kept = rows.join(spare, listed, "left_anti").select(*docs.columns)
    copied = spare.filter("stays").select("row_")
    if copied.isEmpty():
        return kept
    copies = rows.filter("doc_id IS NULL").join(copied, "row_", "left_semi")
    return kept.unionByName(copies.groupBy("row_").agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*"))


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    # a hash of the row stands for its id, which may be NULL
    rows = docs.withColumn("row_", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    leaks = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_")
    leaked = stored(leaks.select(F.col("doc").alias("row_")).distinct())
    return rows.join(leaked, "row_", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in training order, each source to its target."""
    return mixed(docs)


STAGES = [
    ("quality", good_documents),
    ("lines", fresh_lines),
    ("near_duplicates", one_of_each_group),
    ("benchmark", free_of_benchmark),
    ("mixing", source_mix),
]

#: the classifier has no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
