"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare
from wardline.plans.oracle import ORACLE_SQL as LIBRARY_SQL
from wardline.plans.queries import QUERIES as LIBRARY_QUERIES

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, small, duck, name):
    frame = QUERIES[name](spark, small)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(frame.toPandas(), duck.execute(ORACLE[name]).fetchdf()) == ""


def test_every_query_of_the_library_has_sql():
    assert set(LIBRARY_QUERIES) == set(LIBRARY_SQL)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_scans_read_only_what_they_need(spark, small):
    plan = QUERIES["history_counts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
    plan = QUERIES["history_lookup"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "Exchange" not in plan
    plan = QUERIES["source_lineage"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "text:string" not in plan
    plan = QUERIES["class_weights"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan


def test_the_main_path_is_narrow(spark, small):
    """Text to verdict in one stage: no shuffle, no join, no Python for the model."""
    plan = QUERIES["model_verdicts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_no_window_runs_in_one_partition_over_data(spark, small):
    """Windows partition by file, stratum or label; only the frequency histogram and the sizes of ranges are ordered whole."""
    seen = 0
    for name in ("stratified_split", "top_features", "vocabulary_topk", "resolved_labels", "dedup_keep_first"):
        for node in _nodes(QUERIES[name](spark, small)._jdf.queryExecution().executedPlan()):
            if node.nodeName() == "Window":
                seen += 1
                assert not node.partitionSpec().isEmpty() or "_scale" in node.toString()[:400] or "_run" in node.toString()[:400], name
    assert seen >= 5
