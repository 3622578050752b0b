"""One registered query per corpus operator, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.llm import byte_bpe, pii_scan, quality, ranked_search, secret_scan, token_alignment
from exposure.llm.decontamination import find_leaks
from exposure.llm.jaccard_join import jaccard_components
from exposure.llm.line_dedup import without_repeated_lines
from exposure.llm.matches import listed
from exposure.llm.metric_search import top_k
from exposure.llm.mixing import placements
from exposure.llm.substring_dedup import dedup_substrings
from exposure.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _digest(spans: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts of base kinds, the digest of the base spans, and all spans."""
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    return spans.select(
        F.col("doc").alias("doc_id"), *counts, F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


@query
def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document."""
    return _digest(pii_scan.find_pii(_table(spark, sf, "documents")), pii_scan.BASE)


@query
def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document, scanned once per distinct text."""
    spans, _ = secret_scan.find_secrets(_table(spark, sf, "documents"))
    return _digest(spans, secret_scan.BASE)


@query
def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of every page's URL by rules, else by vocabulary."""
    return judge_urls(_table(spark, sf, "pages")).withColumnRenamed("page", "page_id")


@query
def op3_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mix of all documents by source weights takes of each."""
    mix = placements(_table(spark, sf, "documents"))
    return mix.select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_copies"),
        F.round(F.get("copies", F.lit(0))["position"], 6).alias("first_position"),
    )


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents linked by five-word shingle sets of Jaccard similarity 0.75 or more."""
    linked = jaccard_components(_table(spark, sf, "documents"))
    return linked.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op6_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best other vectors by integer inner product, for ids divisible by 100."""
    return top_k(_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op7_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """The best window of every benchmark item that a document leaks."""
    leaks = find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "start_word", "end_word", "similarity")


@query
def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that repeat an earlier line with one edit at most, and the text that is left, per document."""
    kept = without_repeated_lines(_table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words covered by 35-word passages that also start elsewhere, per document."""
    cut = dedup_substrings(_table(spark, sf, "documents"))
    return cut.select(
        F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query
def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.in_held_out_fold("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item by integer BM25."""
    found = ranked_search.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Where tokens of a byte-level and a sentencepiece tokenizer end together, with corpus-wide counts of linked ids."""
    told = token_alignment.linked(_table(spark, sf, "documents"), *token_alignment.default_paths())
    return told.select(F.col("doc").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op13_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document by a byte-level vocabulary, and the bytes they decode to."""
    path, pattern = byte_bpe.default_ranks()
    told = byte_bpe.decode(byte_bpe.encode(_table(spark, sf, "documents"), path, pattern), path)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return told.select(
        F.col("doc").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over all documents."""
    return corpus_pipeline.run(spark, sf)
