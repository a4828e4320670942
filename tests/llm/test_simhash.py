import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardline.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints, most=3):
    """Position of the first member of each fingerprint's component."""
    values = np.array(fingerprints, np.uint64)
    label = np.arange(len(values))
    while True:
        near = [np.flatnonzero(np.bitwise_count(values ^ v) <= most) for v in values]
        lower = np.array([label[n].min() for n in near])
        if (lower == label).all():
            return label
        label = lower


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize(
    "text", [None, "", " ", "One", "one TWO", "one two three", "É é A a b\tc\nd", "\x1c x   y z", "a b c " * 500, "w " * 70_000]
)
def test_fingerprint_is_that_of_the_definition(text):
    assert simhash.fingerprint_of((text or "").encode()) == signed(brute_fingerprint(text))


def clustered(seed, centres, members, bits):
    rng = random.Random(seed)
    values = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(members):
            value = centre
            for _ in range(rng.randint(0, bits)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    return sorted(values)


@pytest.mark.parametrize("seed,centres,members,bits,share", [(1, 60, 6, 4, 2048), (2, 1, 300, 3, 2048), (3, 2, 250, 2, 4), (4, 300, 1, 0, 2)])
def test_components_equal_brute_force(spark, seed, centres, members, bits, share):
    values = clustered(seed, centres, members, bits)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.u: r.v for r in simhash.stars(simhash.links(frame, 3, home_share=share)).collect()}
    component = brute_components(values)
    ours = [found.get(signed(v), signed(v)) for v in values]
    assert len(set(zip(ours, component))) == len(set(ours)) == len(set(component))


def test_every_close_pair_meets_at_an_anchor(spark):
    """Whatever up to three bits differ, one of the two is at home where the other visits."""
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        pairs.append((signed(a), signed(b)))
    visits = simhash.visits(spark.createDataFrame([(v,) for p in pairs for v in p], "fp long")).toPandas()
    assert visits.groupby("fp").size().max() <= 32
    homes = visits[visits.home].groupby("fp").anchor.agg(set)
    every = visits.groupby("fp").anchor.agg(set)
    assert all(homes[a] & every[b] for a, b in pairs)


def test_dense_groups_emit_few_links(spark):
    values = clustered(5, 1, 600, 2)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    assert simhash.links(frame).count() < 40 * len(values)


def test_distance_beyond_the_cover_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_documents_equal_brute_force(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    rows = documents.select("doc_id", "text").toPandas().sort_values("doc_id")
    values = [brute_fingerprint(t) for t in rows.text]
    component = brute_components(values)
    result = simhash.near_duplicates(documents).toPandas().sort_values("doc_id")
    assert result.fingerprint.tolist() == [f"{v:016x}" for v in values]
    assert result.component_id.tolist() == rows.doc_id.to_numpy()[component].tolist()


def test_odd_rows(odd, nothing):
    result = simhash.near_duplicates(odd).toPandas()
    assert len(result) == 10
    assert set(result[result.doc_id.isin([3, 4, 5])].component_id) == {3}
    assert set(result[result.doc_id.isin([1])].component_id) == {1}
    assert result[result.doc_id.isna()].component_id.isna().all()
    kept = simhash.keep_one(odd)
    rows = kept.toPandas()
    assert kept.columns == odd.columns
    assert sorted(rows.doc_id.dropna()) == [1, 2, 3, 6, 7] and rows.doc_id.isna().sum() == 1
    assert rows[rows.doc_id == 2].text.tolist() == ["another text under a repeated id"]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_one_of_each_group_stays(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    ids = {r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert {r.doc_id for r in simhash.keep_one(documents.withColumn("extra", F.lit(1))).collect()} == ids
