"""A corpus pipeline: toxicity, line dedup, near dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs (doc_id, text, lang, source, n_chars, and whatever
columns there are besides). The first and third drop documents, the second and fourth change texts, the last says where
every document goes. Null, empty and repeated rows have the results that the operators define.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import lines, packing, secret_scan, simhash, token_counts, toxicity
from wardline.session import shared_dir


#: Sources are far larger than hosts, so a passage of 50 words counts as repeated from min_pages documents on. A document
#: that loses most of its text is a copy, for the next stage.
LINES = lines.Settings(long_words=50, max_lost=0.5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to labelled rows of docs, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines on too many documents of a source are gone, and n_chars follows the text.

    A document that would lose over half of its shown characters keeps them all, so near copies reach the next stage whole.
    """
    return _counted(lines.drop_boilerplate(docs, F.col("source"), "text", LINES))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; found secrets are masked in their texts, and n_chars follows the text."""
    return secret_scan.redact(docs, secret_scan.new_ledger(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, length in tokens, bucket, padded_length, batch_id, position of all documents."""
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return packing.pack(counted.withColumnRenamed("n_tokens", "length"), ["doc_id", "length"], packing.Settings(to_rows=True))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", keep_distinct),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: The stages fit a model, follow links and choose boundaries, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each is written to the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
