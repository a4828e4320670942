import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from wardline.llm import digest_index


def _digest(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()


def _expected(rows):
    """(doc_id, digest) to (keep_id, group_size) of one batch."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(_digest(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return {d: (min(g)[3], len(g)) for d, g in groups.items()}


def test_one_batch_against_brute_force(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    expected = _expected(rows)
    found = digest_index.ingest(digest_index.new_index(spark, 4), odd, "a").collect()
    assert Counter(r["doc_id"] for r in found) == Counter(doc_id for doc_id, _ in rows)
    assert Counter(r["text_sha256"] for r in found) == Counter(_digest(text) for _, text in rows)
    assert all((r["keep_id"], r["group_size"]) == expected[r["text_sha256"]] for r in found)
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept) == set(expected) and set(kept.values()) == {1}
    # The blank text is longer than the empty ones that equal it.
    assert {r["keep_id"] for r in found if r["text_sha256"] == _digest("")} == {5}


def test_empty_table(spark, nothing):
    assert digest_index.ingest(digest_index.new_index(spark, 4), nothing, "a").collect() == []


def test_later_batches_and_repeated_batches(spark, tmp_path):
    first = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a  b"), (5, "d"), (6, "d"), (7, "c")], "doc_id long, text string")
    path = str(tmp_path / "index")
    index = digest_index.open_index(spark, path, 4)

    def told(batch, name):
        return sorted(map(tuple, digest_index.ingest(index, batch, name).drop("text_sha256").collect()))

    one = told(first, "one")
    assert one == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]
    two = [(4, 1, 1, False), (5, 5, 2, True), (6, 5, 2, False), (7, 3, 1, False)]
    assert told(second, "two") == two
    # A batch that is run again, after a failure or by mistake, changes nothing.
    assert told(second, "two") == two and told(first, "one") == one
    assert index.entries(spark).count() == 3
    # Another session finds the index by its path.
    spark.sql(f"DROP TABLE {index.table}")
    index = digest_index.open_index(spark, path)
    assert index.buckets == 4 and index.entries(spark).count() == 3
    third = spark.createDataFrame([(8, "c"), (9, "e")], "doc_id long, text string")
    assert told(third, "three") == [(8, 3, 1, False), (9, 9, 1, True)]
    assert [r[0] for r in digest_index.drop_copies(third.withColumn("kept", F.lit(0)), index, "four").collect()] == []


def test_the_index_is_joined_in_its_buckets(spark):
    index = digest_index.new_index(spark, 8)
    batch = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    digest_index.ingest(index, batch, "one").count()
    groups = digest_index.digests(batch).groupBy("digest").count()
    joined = groups.join(index.entries(spark).select("digest").hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 8 out of 8" in plan
    assert plan.count("Exchange") == 1  # that of the groups


def test_batch_names(spark):
    with pytest.raises(ValueError):
        digest_index.ingest(digest_index.new_index(spark, 4), spark.createDataFrame([], "doc_id long, text string"), "a'b")


def test_a_group_of_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    found = digest_index.ingest(digest_index.new_index(spark, 4), rows, "a")
    hot = found.filter("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.count_if("kept")).first()
    assert tuple(hot) == (1000, 0, 0, 1) and found.filter("kept").count() == 2001
