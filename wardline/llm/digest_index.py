"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text, with one partition of files a
batch. A batch is reduced to one row a digest, joined to the index by a sort-merge anti-join, and the digests that the index
lacks are appended. Only the batch is shuffled: the index is read bucket by bucket as it lies. An entry never changes once
it is written, so a document that was kept stays kept; running a batch again replaces that batch's own files.

A digest may own a third of all rows. Groups are minima and counts that combine before the shuffle, and the entries of
frequent digests reach their rows by the bounded broadcast of ``operators.lookup``.

Defined results: a null text counts as empty, and all empty texts are equal. Of equal texts of one batch the row with the
most code points before normalisation stays, then the smallest id, null ids last; of repeated rows of one id exactly one
stays. If an earlier batch has the text, no row of this one stays and keep_id is that of the index. group_size counts the
rows of the batch. Texts of any length are read whole. Other columns of the documents are not returned.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lookup import attach_key_facts
from ..session import materialize, new_table_path, path_exists

SEPARATORS = r"[\x20\x09-\x0D]+"
SPEC = "buckets int"
BATCH_NAME = re.compile(r"[A-Za-z0-9_.-]+")


@dataclass(frozen=True)
class DigestIndex:
    """An opened index: the name it has in the session's catalog, and its number of buckets."""

    table: str
    buckets: int

    def entries(self, spark: SparkSession) -> DataFrame:
        """digest, keep_id, keep_row, batch."""
        return spark.table(self.table)


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
    """The index below ``path``, created if there is none.

    ``buckets`` (default: the session's shuffle partitions) is fixed when the index is created. Choose it so that a bucket
    of the whole index suits a task (about 150 bytes a distinct text), and not below the shuffle partitions of the sessions
    that use it: Spark prefers a shuffle of the index to fewer tasks than that.
    """
    spec = f"{path.rstrip('/')}/spec"
    if not path_exists(spark, spec):
        chosen = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(chosen,)], SPEC).write.json(spec)
    chosen = spark.read.schema(SPEC).json(spec).first()["buckets"]
    name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
        f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {chosen} BUCKETS "
        f"LOCATION '{path.rstrip('/')}/entries'"
    )
    if path_exists(spark, f"{path.rstrip('/')}/entries"):
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return DigestIndex(name, chosen)


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder."""
    return open_index(spark, new_table_path(spark, "digest-index"), buckets)


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, "")


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, chars and a row number, written once: texts are read a single time."""
    shown = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = shown.select(
        "doc_id",
        F.sha2(normalized(F.col("text")), 256).alias("digest"),
        F.length("text").cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    return materialize(found, "digests")


def ingest(index: DigestIndex, documents: DataFrame, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deduplicate a batch of documents against the index and append what is new.

    Returns one row a document: doc_id, keep_id, group_size, kept, text_sha256.
    """
    if not BATCH_NAME.fullmatch(batch):
        raise ValueError(f"a batch is named by letters, digits, '_', '.' and '-'; got {batch!r}")
    spark = documents.sparkSession
    rows = digests(documents, key, text)
    best = F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = rows.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"))
    groups = materialize(groups, "digest-groups")

    earlier = index.entries(spark).filter(F.col("batch") != batch).select("digest")
    unseen = groups.join(earlier.hint("merge"), "digest", "left_anti")
    entries = unseen.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    entries = materialize(entries, "digest-entries")  # a table is not overwritten by a plan that reads it
    # One task a bucket, hence one file a bucket; of the table only this batch's partition is replaced.
    spark.sql(
        f"INSERT OVERWRITE TABLE {index.table} PARTITION (batch = '{batch}') SELECT * FROM {{entries}}",
        entries=entries.repartition(index.buckets, "digest"),
    )

    known = groups.select("digest", "copies").join(index.entries(spark).hint("merge"), "digest")
    known = materialize(known, "digest-facts")
    told = attach_key_facts(rows, known, "digest", F.col("row"), hot_floor=1)
    return told.select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(documents: DataFrame, index: DigestIndex, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of a batch whose row stays; ids must be unique and not null within the batch."""
    kept = ingest(index, documents, batch, key, text).filter("kept").select(F.col("doc_id").alias("_kept_id"))
    return documents.join(kept, F.col(key) == F.col("_kept_id"), "left_semi")
