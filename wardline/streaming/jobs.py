"""The online loop as streams: score prompts and append, rolling trend, headline counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import utc_day
from ..operators.admission import accepted, rejected
from ..operators.history import headline_columns, is_safe
from ..operators.hybrid import analyze
from ..sources.history import BLOOM_IDS, identify, log_rows, stream_part
from ..session import path_exists
from ..sources.rules import RULES


def scored_stream(
    prompts: DataFrame, key: Column, created_at: Column | None = None, rules=RULES, max_chars: int | None = None
) -> DataFrame:
    """Admitted prompts with ``probabilities`` to identified analyses.

    Row-local from end to end: no state, no shuffle, the same code as a batch.
    """
    keyed = accepted(prompts, max_chars=max_chars).withColumn("_key", key)
    kept = ["_key"]
    if created_at is not None:
        keyed, kept = keyed.withColumn("_at", created_at), ["_key", "_at"]
    records = analyze(keyed, rules, keep=kept)
    at = F.col("_at") if created_at is not None else None
    return identify(records, F.col("_key"), created_at=at)


def append_stream(analyses: DataFrame, log_path: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream of analyses to the log, exactly once (file sink)."""
    return (
        log_rows(analyses)
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("parquet.bloom.filter.expected.ndv#id", str(BLOOM_IDS))
        .option("path", stream_part(log_path))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def table_stream(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataStreamWriter:
    """Keep the result of an aggregate stream: every batch writes its own folder below ``path``.

    A folder appears whole or not at all and a batch that is run again replaces its own, so readers and lost drivers
    never meet half a result. Read it with `latest_table` (complete mode) or `latest_rows` (update mode).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return result.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)


def latest_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The result as of the last batch of a `table_stream` in complete mode."""
    batches = _batches(spark, path, schema)
    return batches.filter(F.col("batch") == batches.agg(F.max("batch")).scalar()).drop("batch")


def latest_rows(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last value of every key of a `table_stream` in update mode, which writes changed rows alone."""
    values = F.struct(*[name for name in schema.names if name not in keys])
    last = _batches(spark, path, schema).groupBy(*keys).agg(F.max_by(values, "batch").alias("_last"))
    return last.select(*[F.col(n) if n in keys else F.col(f"_last.{n}") for n in schema.names])


def gate_stream(log: DataFrame, delay: str, path: str, checkpoint: str, time_col: str = "created_at") -> DataStreamWriter:
    """Divide a stream into rows in time and rows of days that are closed, so that none vanishes at a watermark.

    A day is closed once a batch before this one held a row ``delay`` past its end. Writes ``path``/on_time and
    ``path``/late, a folder a batch. A batch that is run again is left as it is once its rows in time are there, which
    are written last; so a stream over them (`on_time_rows`) reads every row once.
    """

    def divide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if path_exists(spark, f"{path}/on_time/batch-{number}/_SUCCESS"):
            return
        seen = f"{path}/seen"
        newest = None
        if number and path_exists(spark, seen):
            schema = f"{time_col} timestamp, batch long"
            newest = spark.read.schema(schema).parquet(seen).filter(F.col("batch") < number).agg(F.max(time_col)).first()[0]
        day_end = F.expr(f"window({time_col}, '1 day').end")
        closed = F.lit(False) if newest is None else F.coalesce(day_end <= F.lit(newest) - F.expr(f"interval {delay}"), F.lit(False))
        batch = batch.withColumn("_closed", closed)
        batch.filter("_closed").drop("_closed").write.mode("overwrite").parquet(f"{path}/late/batch-{number}")
        batch.agg(F.max(time_col).alias(time_col)).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        batch.filter("NOT _closed").drop("_closed").write.mode("overwrite").parquet(f"{path}/on_time/batch-{number}")

    return log.writeStream.foreachBatch(divide).option("checkpointLocation", checkpoint)


def on_time_rows(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """The rows that a `gate_stream` let through, as a stream.

    It reads them in their order, in batches no smaller than the gate's, so its watermark is never ahead of the gate's
    and a `bounded_trend_stream` with the same delay drops none of them.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}/on_time")


def late_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that a `gate_stream` set aside."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/late")


def rejected_stream(prompts: DataFrame, path: str, checkpoint: str, max_chars: int | None = None) -> DataStreamWriter:
    """Append the prompts that `scored_stream` leaves out, with their reason, to a table."""
    writer = rejected(prompts, max_chars=max_chars).writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).outputMode("append")


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(is_safe(), 0).otherwise(1)).alias("threats"),
    ]


def trend_stream(log: DataFrame) -> DataFrame:
    """Analyses and threats per UTC day; run in complete mode. State: one row per day."""
    return log.groupBy(utc_day(F.col("created_at")).alias("day")).agg(*_counts())


def bounded_trend_stream(log: DataFrame, delay: str) -> DataFrame:
    """The trend with days closed once the watermark passes them; append or update mode.

    Rows of closed days are dropped by design; put a `gate_stream` before it where none may be.
    Windows are UTC days. The window struct itself is the grouping key: grouping by one of
    its fields would lose the watermark.
    """
    grouped = log.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day")).agg(*_counts())
    return grouped.select(utc_day(F.col("window.start")).alias("day"), "count", "threats")


def headline_stream(log: DataFrame) -> DataFrame:
    """Total, safe, threat and high-risk counts; run in complete mode."""
    return log.groupBy().agg(*headline_columns())


def class_mix_stream(log: DataFrame) -> DataFrame:
    """Analyses per classification; run in complete mode. State: one row per label."""
    return log.groupBy(F.col("classification").alias("label")).agg(F.count(F.lit(1)).alias("count"))
