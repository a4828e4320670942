import datetime as dt
import time

from wardline.operators import history
from wardline.streaming import jobs

SCHEMA = "created_at timestamp, classification string"


def _at(day, hour=12):
    return dt.datetime(2024, 5, day, hour)


def _feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def _run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_no_row_vanishes_at_a_watermark(spark, tmp_path):
    source, gate, trend = (str(tmp_path / n) for n in ("in", "gate", "trend"))
    batches = [
        [(_at(1), "Safe Prompt"), (_at(2), "Jailbreak")],
        [(_at(10), "Jailbreak"), (_at(1), "Jailbreak")],  # the 1st is open still: no earlier batch was past it
        [(_at(1), "Safe Prompt"), (_at(9), "Safe Prompt"), (_at(10), "Safe Prompt"), (None, "Safe Prompt")],  # the 1st is closed now
        [(_at(7, 23), "Jailbreak"), (_at(11), "Jailbreak")],  # the 7th ended two days and more before the 10th
    ]
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in batches:
        _feed(spark, source, rows)
        arriving = spark.readStream.schema(schema).parquet(source)
        _run(jobs.gate_stream(arriving, "2 days", gate, str(tmp_path / "c1")))
        counted = jobs.bounded_trend_stream(jobs.on_time_rows(spark, gate, schema), "2 days")
        _run(jobs.table_stream(counted, trend, str(tmp_path / "c2"), "update"))
    late = {(r[0], r[1]) for r in jobs.late_rows(spark, gate, schema).collect()}
    assert late == {(_at(1), "Safe Prompt"), (_at(7, 23), "Jailbreak")}
    got = {r["day"]: (r["count"], r["threats"]) for r in jobs.latest_rows(spark, trend, counted.schema, ["day"]).collect()}
    assert got == {"2024-05-01": (2, 1), "2024-05-02": (1, 1), "2024-05-09": (1, 0), "2024-05-10": (2, 1), "2024-05-11": (1, 1)}
    every = spark.read.schema(schema).parquet(source).filter("created_at IS NOT NULL")
    total = {r["day"]: r["count"] for r in history.daily_trend(every).collect()}
    both = {d: got.get(d, (0, 0))[0] + sum(str(t.date()) == d for t, _ in late) for d in total}
    assert both == total


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    source, gate = str(tmp_path / "in"), str(tmp_path / "gate")
    schema = spark.createDataFrame([], SCHEMA).schema
    _feed(spark, source, [(_at(1), "Safe Prompt")])
    for checkpoint in ("c1", "c2"):  # a lost checkpoint starts again at batch 0
        _run(jobs.gate_stream(spark.readStream.schema(schema).parquet(source), "2 days", gate, str(tmp_path / checkpoint)))
    assert spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{gate}/on_time").count() == 1


def test_complete_tables_are_read_as_of_the_last_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    schema = spark.createDataFrame([], SCHEMA).schema
    for n in (1, 2):
        _feed(spark, source, [(_at(1), "Safe Prompt")] * n)
        result = jobs.class_mix_stream(spark.readStream.schema(schema).parquet(source))
        _run(jobs.table_stream(result, path, str(tmp_path / "c")))
        assert [tuple(r) for r in jobs.latest_table(spark, path, result.schema).collect()] == [("Safe Prompt", n * (n + 1) // 2)]
