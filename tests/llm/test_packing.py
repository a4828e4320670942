import itertools
import random

import pytest
from pyspark.sql import functions as F

from wardline.llm import packing
from wardline.llm.packing import Settings


def brute_padding(cells, buckets):
    size = len(cells)
    cost = lambda part: sum(part[-1][0] * rows - total for _, rows, total in part)
    return min(
        sum(cost(cells[a:b]) for a, b in itertools.pairwise((0, *cuts, size)))
        for used in range(min(buckets, size))
        for cuts in itertools.combinations(range(1, size), used)
    )


@pytest.mark.parametrize("seed", range(60))
def test_boundaries_pad_least(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(50), rng.randint(1, 9)))
    cells = [(n, rows := rng.randint(1, 6), n * rows - rng.randint(0, 2) * (n > 20)) for n in lengths]
    buckets = rng.randint(1, 6)
    plan = packing.best_boundaries(cells, buckets)
    assert plan.padding == brute_padding(cells, buckets)
    assert len(plan.boundaries) <= buckets and sum(plan.counts) == sum(rows for _, rows, _ in cells)
    assert plan.boundaries == sorted(set(plan.boundaries)) and plan.boundaries[-1] == lengths[-1]


def test_grid_is_exact_below_and_close_above(spark):
    lengths = [0, 1, 7, 4095, 4096, 4097, 5000, 123_456_789, (1 << 40) + 1, (1 << 20) - 1]
    frame = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", packing.cell(F.col("n")).alias("c"))
    for n, c in frame.collect():
        assert c == n if n <= packing.FINE else n <= c <= n * (1 + 1 / 200)
        assert c == frame.sparkSession.createDataFrame([(c,)], "n long").select(packing.cell(F.col("n"))).first()[0]


def test_batches_fill_the_budget_and_hold_every_row_once(spark):
    rng = random.Random(3)
    lengths = [min(int(rng.lognormvariate(4, 1.2)), 5000) for _ in range(3000)] + [17] * 1500
    frame = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    settings = Settings(buckets=6, batch_tokens=2000, part_rows=100)
    packed = packing.pack(frame, ["doc_id"], settings).toPandas()
    assert sorted(packed.doc_id) == list(range(4500)) and (packed.length <= packed.padded_length).all()
    assert not packed.duplicated(["batch_id", "position"]).any()
    assert sorted(packed.batch_id.unique()) == list(range(packed.batch_id.max() + 1))
    for _, bucket in packed.groupby("bucket"):
        fits = max(1, 2000 // bucket.padded_length.iloc[0])
        sizes = bucket.groupby("batch_id").size()
        assert bucket.padded_length.nunique() == 1 and (sizes.sort_index().iloc[:-1] == fits).all() and sizes.max() <= fits
    counts = sorted((n, lengths.count(n), n * lengths.count(n)) for n in set(lengths))
    cells = {}
    for r in frame.groupBy(packing.cell(F.col("length")).alias("c")).agg(F.count("*").alias("n"), F.sum("length").alias("s")).collect():
        cells[r.c] = (r.c, r.n, r.s)
    assert (packed.padded_length - packed.length).sum() == packing.best_boundaries(sorted(cells.values()), 6).padding
    assert sum(n for _, n, _ in counts) == 4500


def test_long_rows_are_padded_to_rows(spark):
    """Beyond the exact cells a boundary is the longest row of its bucket, and the plan's padding is that of the rows."""
    lengths = [10] * 5 + [5001] * 4 + [9001, 9002, 70_001, 70_001]
    frame = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    packed = packing.pack(frame, ["doc_id"], Settings(buckets=4, to_rows=True)).toPandas()
    longest = packed.groupby("bucket").length.max()
    assert longest.tolist() == [10, 5001, 9002, 70_001] and (packed.padded_length == packed.bucket.map(longest)).all()
    assert packing.plan(frame.select("length"), Settings(buckets=4, to_rows=True)).padding == 1


def test_result_does_not_depend_on_partitions(spark):
    frame = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") * 7 % 90).alias("length"))
    settings = Settings(buckets=4, batch_tokens=300, part_rows=30)
    one, two = (packing.pack(frame.repartition(n), ["doc_id"], settings).toPandas().sort_values("doc_id") for n in (1, 7))
    assert one.reset_index(drop=True).equals(two.reset_index(drop=True))


def test_odd_rows(spark):
    rows = [(1, None, "x", [1]), (None, 5, "y", None), (1, None, "x", [1]), (2, 0, None, []), (3, -4, "z", [2]), (4, 10**9, "w", [])]
    frame = spark.createDataFrame(rows, "doc_id long, length long, bucket string, _order array<int>")
    packed = packing.pack(frame, ["doc_id"], Settings(batch_tokens=100))
    result = packed.toPandas()
    assert packed.columns == ["doc_id", "_order", "length", "bucket", "padded_length", "batch_id", "position"]
    assert len(result) == 6 and (result.length[result.doc_id == 1] == 0).all()
    assert result[result.length == 10**9].batch_id.nunique() == 1 == (result.batch_id == result[result.length == 10**9].batch_id.iloc[0]).sum()
    nothing = packing.pack(frame.limit(0), ["doc_id"])
    assert nothing.count() == 0 and nothing.columns == packed.columns
