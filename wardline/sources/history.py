"""The log of analyses: Parquet partitioned by UTC day.

Batches and streams write to separate parts of the log: a streaming file sink keeps its own
list of valid files and would hide files written beside it. `read_log` unites the parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import now_utc_seconds, utc_day
from ..session import materialize, path_exists

DETAIL_COLUMNS = [
    "confidence_percent",
    "ml_prediction",
    "hybrid_scores",
    "rule_score",
    "triggered_indicators",
    "explanations",
    "mitigations",
]
LOG_COLUMNS = [
    "id",
    "created_at",
    "prompt",
    "classification",
    "confidence",
    "risk_score",
    "risk_level",
    "severity",
    *DETAIL_COLUMNS,
]
ID_CHARS = 32


def analysis_id(*parts: Column) -> Column:
    """A 32-character hex id. Derived from the row, so a retried task writes the same id."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, ID_CHARS)


def identify(analyses: DataFrame, *key: Column, created_at: Column | None = None) -> DataFrame:
    """Add ``id`` and ``created_at`` (default: now, UTC, whole seconds).

    ``key`` tells analyses of one run apart, for example the source row. Without it, equal
    prompts analysed in the same second share an id.
    """
    stamped = analyses.withColumn("created_at", created_at if created_at is not None else now_utc_seconds())
    parts = [F.col("prompt"), F.unix_micros("created_at"), *key]
    return stamped.withColumn("id", analysis_id(*parts))


def batch_part(path: str) -> str:
    return f"{path.rstrip('/')}/batch"


def stream_part(path: str) -> str:
    return f"{path.rstrip('/')}/stream"


def log_rows(analyses: DataFrame) -> DataFrame:
    """Identified analyses as log rows with their partition day."""
    return analyses.select(*LOG_COLUMNS).withColumn("day", utc_day(F.col("created_at")))


#: A bloom filter on the id lets a point read skip row groups; values a filter is laid out for, in a row group.
BLOOM_IDS = 1_000_000


def write_log_part(rows: DataFrame, path: str, batch: str) -> None:
    """Write rows with ``id`` and ``day`` as one batch of a log, in place of what that batch wrote before.

    The batch's own folder is the unit of commit: a run that is repeated leaves one copy, other batches are untouched.
    """
    writer = rows.write.mode("overwrite").partitionBy("day")
    writer = writer.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", str(BLOOM_IDS))
    writer.parquet(f"{batch_part(path)}/run={batch}")


def append_analyses(analyses: DataFrame, path: str, batch: str | None = None) -> None:
    """Append identified analyses to the log, once however often it is run.

    ``batch`` names the run; a run of the same name replaces the earlier one. By default the name is a digest of the ids,
    so the same analyses again, in whatever order, are the same batch.
    """
    rows = materialize(log_rows(analyses), "log-rows")  # an id may hold the current time, so it is taken once
    if batch is None:
        told = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.reverse("id"))).alias("y"))
        batch = told.select(F.sha2(F.concat_ws("|", "n", "x", "y"), 256)).first()[0][:ID_CHARS]
    write_log_part(rows, path, batch)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All analyses of the log, from batches and streams."""
    parts = [p for p in (batch_part(path), stream_part(path)) if path_exists(spark, p)]
    if not parts:
        raise FileNotFoundError(f"no log at {path}")
    return reduce(DataFrame.unionByName, [spark.read.parquet(p).drop("run") for p in parts])


def clear_log(spark: SparkSession, path: str) -> None:
    """Replace the log by an empty one of the same schema.

    A stream that writes to the log must be stopped first and needs a new checkpoint.
    """
    schema = read_log(spark, path).drop("day").schema
    for part in (batch_part(path), stream_part(path)):
        if path_exists(spark, part):
            spark.createDataFrame([], schema).withColumn("day", F.lit("")).write.mode("overwrite").parquet(part)


def result_json(record_columns=LOG_COLUMNS) -> Column:
    """The analysis record as one JSON text, for consumers outside Spark."""
    return F.to_json(F.struct(*record_columns))


def parse_result(json_text: Column, schema) -> Column:
    return F.from_json(json_text, schema)
