import datetime as dt
import textwrap

import pytest
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.operators import admission, history, hybrid, report
from wardline.plans import fixtures
from wardline.sources import history as log_store
from wardline.streaming import jobs


@pytest.fixture(scope="module")
def records(spark, small):
    prompts = admission.accepted(fixtures.prompts_with_probabilities(spark, small))
    return hybrid.analyze(prompts, keep=["doc_id"]).cache()


def test_append_read_lookup_clear(spark, records, tmp_path):
    path = str(tmp_path / "log")
    first = log_store.identify(records, F.col("doc_id"), created_at=F.lit("2024-03-01 23:59:59").cast("timestamp"))
    second = log_store.identify(records, F.col("doc_id"))
    log_store.append_analyses(first, path)
    log_store.append_analyses(second, path)
    log = log_store.read_log(spark, path)
    assert log.count() == 2 * records.count() and log.select("id").distinct().count() == log.count()
    assert {str(r["day"]) for r in log.select("day").distinct().collect()} >= {"2024-03-01"}
    wanted = first.orderBy("doc_id").first()
    found = history.lookup(log, wanted["id"]).collect()
    assert len(found) == 1 and found[0]["prompt"] == wanted["prompt"] and len(wanted["id"]) == 32
    assert found[0]["triggered_indicators"] == wanted["triggered_indicators"]
    assert history.lookup(log, "absent").count() == 0
    counts = history.headline_counts(log).first()
    assert counts["total"] == counts["safe"] + counts["threats"] == log.count()
    log_store.clear_log(spark, path)
    assert log_store.read_log(spark, path).count() == 0


def test_appending_twice_leaves_one_copy(spark, records, tmp_path):
    path = str(tmp_path / "log")
    at = F.lit("2024-03-01 10:00:00").cast("timestamp")
    rows = log_store.identify(records, F.col("doc_id"), created_at=at)
    for again in (rows, rows.repartition(3)):
        log_store.append_analyses(again, path)
    assert log_store.read_log(spark, path).count() == records.count()
    log_store.append_analyses(rows.limit(5), path, "named")
    log_store.append_analyses(rows.limit(7), path, "named")
    assert log_store.read_log(spark, path).count() == records.count() + 7
    log_store.clear_log(spark, path)
    log_store.append_analyses(rows, path)
    assert log_store.read_log(spark, path).count() == records.count()


def test_log_reads_are_pruned(spark, small, tmp_path):
    log = fixtures.analyses_log(spark, small).withColumn("day", text.utc_day(F.col("created_at")))
    log_store.write_log_part(log, str(tmp_path / "log"), "all")
    written = log_store.read_log(spark, str(tmp_path / "log"))
    newest = history.recent(written, 30)
    assert newest.collect() == history.recent(log.drop("day"), 30).collect()
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-30" in plan
    assert history.recent(written.filter("risk_score < 0"), 5).count() == 0
    one = history.lookup(written, "evt-321", "2024-01-02")
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()


def test_retry_gives_the_same_ids(records):
    at = F.lit("2024-03-01 10:00:00").cast("timestamp")
    once = {r["id"] for r in log_store.identify(records, F.col("doc_id"), created_at=at).select("id").collect()}
    again = {r["id"] for r in log_store.identify(records.repartition(5), F.col("doc_id"), created_at=at).select("id").collect()}
    assert once == again and len(once) == records.count()


def test_recent_clamps_its_limit(spark, small):
    log = fixtures.analyses_log(spark, small)
    assert history.recent(log, 0).count() == 1
    assert history.recent(log, 999).count() == 200
    assert history.recent(log).count() == 50
    newest = history.recent(log, 3).collect()
    assert [r["created_at"] for r in newest] == sorted((r["created_at"] for r in newest), reverse=True)


def test_days_are_utc_in_any_session_zone(spark, small):
    base = [tuple(r) for r in history.daily_trend(fixtures.analyses_log(spark, small)).collect()]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [tuple(r) for r in history.daily_trend(fixtures.analyses_log(spark, small)).collect()] == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_json_round_trip(records):
    fields = [c for c in records.columns if c != "doc_id"]
    parsed = records.select("*", log_store.parse_result(log_store.result_json(fields), records.select(*fields).schema).alias("r"))
    row = parsed.first()
    assert row["r"]["mitigations"] == row["mitigations"] and row["r"]["hybrid_scores"] == row["hybrid_scores"]


def _expected_lines(row):
    lines = [
        report.TITLE, "Generated: G", f"Analysis ID: {row['id']}", "",
        f"Classification: {row['classification']}", f"Confidence: {row['confidence_percent']}%",
        f"Risk Score: {row['risk_score']}", f"Risk Level: {row['risk_level']}", f"Severity: {row['severity']}", "",
        "Triggered Indicators:",
    ]
    for hit in row["triggered_indicators"]:
        lines.append(f"- {hit['rule_id']} | {hit['category']} | {hit['label']}")
        lines += textwrap.wrap(f"  Evidence: {hit['evidence']}", 92)
    if not row["triggered_indicators"]:
        lines.append("- None")
    for title, items in (("Explanation:", row["explanations"]), ("Mitigation Recommendations:", row["mitigations"])):
        lines += ["", title]
        for item in items:
            lines += textwrap.wrap(f"- {item}", 94)
    lines += ["", "Original Prompt:"] + textwrap.wrap(row["prompt"], 94)
    return lines


def test_report_lines(records):
    named = records.withColumn("id", F.col("doc_id").cast("string")).withColumn("generated_at", F.lit("G"))
    got = {}
    for r in report.report_lines(named).collect():
        got.setdefault(r["id"], []).append((r["line_no"], r["line"]))
    rows = named.collect()
    assert len(got) == len(rows)
    for row in rows:
        assert [line for _, line in sorted(got[row["id"]])] == _expected_lines(row)


def _event_files(spark, small, folder):
    """Four files that arrive in the order of their events."""
    events = spark.read.parquet(f"{small}/events.parquet")
    for first, last in ((1, 8), (8, 16), (16, 24), (24, 32)):
        part = events.filter((F.dayofmonth("ts") >= first) & (F.dayofmonth("ts") < last))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_streams_equal_batches(spark, small, tmp_path):
    log = fixtures.analyses_log(spark, small)
    stream = fixtures.as_log(_event_files(spark, small, str(tmp_path / "events")))
    _run(jobs.trend_stream(stream), "t_trend", "complete")
    assert sorted(tuple(r) for r in spark.table("t_trend").collect()) == [tuple(r) for r in history.daily_trend(log).collect()]
    _run(jobs.headline_stream(stream), "t_counts", "complete")
    assert spark.table("t_counts").collect() == history.headline_counts(log).collect()
    _run(jobs.class_mix_stream(stream), "t_mix", "complete")
    assert sorted(map(tuple, spark.table("t_mix").collect())) == sorted(map(tuple, history.counts_by_type(log).collect()))


def test_watermarked_trend_closes_days_correctly(spark, small, tmp_path):
    log = fixtures.analyses_log(spark, small)
    stream = fixtures.as_log(_event_files(spark, small, str(tmp_path / "events")))
    _run(jobs.bounded_trend_stream(stream, "1 day"), "t_bounded", "append")
    closed = {r["day"]: (r["count"], r["threats"]) for r in spark.table("t_bounded").collect()}
    full = {r["day"]: (r["count"], r["threats"]) for r in history.daily_trend(log).collect()}
    assert len(closed) >= 27 and all(full[day] == value for day, value in closed.items())


def test_scored_stream_equals_batch(spark, small, records, tmp_path):
    source = str(tmp_path / "prompts")
    fixtures.prompts_with_probabilities(spark, small).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    at = F.lit(dt.datetime(2024, 5, 1, 12)).cast("timestamp")
    scored = jobs.scored_stream(stream, F.col("doc_id"), at)
    for _ in range(2):  # a restart from the checkpoint appends nothing twice
        jobs.append_stream(scored, str(tmp_path / "log"), str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    stored = log_store.read_log(spark, str(tmp_path / "log"))
    batch = log_store.identify(records, F.col("doc_id"), created_at=at)
    columns = ["id", "prompt", "classification", "risk_score", "explanations", "mitigations"]
    assert sorted(map(str, stored.select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))
    log_store.append_analyses(log_store.identify(records, F.col("doc_id")), str(tmp_path / "log"))
    assert log_store.read_log(spark, str(tmp_path / "log")).count() == 2 * records.count()
    log_store.clear_log(spark, str(tmp_path / "log"))
    assert log_store.read_log(spark, str(tmp_path / "log")).count() == 0


def test_reading_an_absent_log(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        log_store.read_log(spark, str(tmp_path / "nowhere"))


def test_utc_helpers(spark):
    row = spark.range(1).select(text.utc_text(text.instant_from_utc(F.lit("2024-01-31 12:30:45").cast("timestamp_ntz")))).first()
    assert row[0] == "2024-01-31 12:30:45"
