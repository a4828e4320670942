"""The registered queries: each applies its operator with production settings to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from . import bpe, digest_index, filter_audit, lines, outliers, packing, search, secret_scan, simhash, token_counts, toxicity
from . import weak_quality, whitening


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return toxicity.classify(documents, toxicity.fit(documents, _table(spark, folder, "labels")))


def op2_search(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    queries = documents.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(documents, queries)


def op3_token_counts(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(_table(spark, folder, "documents"), path)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    found = secret_scan.with_findings(documents, secret_scan.new_ledger(spark)).drop("text")
    base = [rule.kind for rule in secret_scan.BASE_RULES]
    counts = [secret_scan.count_of(F.col("_findings"), kind).alias(f"n_{kind}") for kind in base]
    of_base = F.filter("_findings", lambda x: x["rank"] < len(base))
    digest = F.sha2(secret_scan.span_text(of_base), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secret_scan.span_text(F.col("_findings")).alias("spans"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return weak_quality.classify(_table(spark, folder, "documents"))


def op7_bpe(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    coded = bpe.digests(F.col("text"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return _table(spark, folder, "documents").select("doc_id", coded.alias("_coded")).select("doc_id", "_coded.*")


def op8_packing(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    counted = op3_token_counts(spark, folder, vocabulary).withColumnRenamed("n_tokens", "length")
    return packing.pack(counted, ["doc_id", "length"], packing.Settings(to_rows=True))


def op9_lines(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    shown = pages.select("page_id", lines.host_of(F.col("url")).alias("host"), lines.page_text(F.col("html")).alias("text"))
    shown = materialize(shown, "page-lines")  # pages are parsed once, though their lines are read twice
    shown = shown.withColumn("n_before", F.size(F.split("text", "\n")))
    left = lines.drop_boilerplate(shown, F.col("host"), "text")
    dropped = (F.col("n_before") - F.size(F.split("text", "\n"))).cast("long")
    return left.select("page_id", "host", "text", dropped.alias("n_dropped"))


def op10_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judge(_table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    failed = filter_audit.failures(_table(spark, folder, "documents"))
    return filter_audit.audit(filter_audit.with_labels(failed, _table(spark, folder, "labels")))


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return digest_index.ingest(digest_index.new_index(spark), _table(spark, folder, "documents"), "documents")


QUERIES = {"op1_toxicity": op1_toxicity, "op2_search": op2_search, "op3_token_counts": op3_token_counts, "op4_simhash": op4_simhash, "op5_secrets": op5_secrets, "op6_quality": op6_quality, "op7_bpe": op7_bpe, "op8_packing": op8_packing, "op9_lines": op9_lines, "op10_outliers": op10_outliers, "op11_whitening": op11_whitening, "op12_filter_audit": op12_filter_audit, "op13_exact_dedup": op13_exact_dedup}
