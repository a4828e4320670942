import zlib

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import hashed, toxicity


def test_words_are_hashed_alike_wherever_they_stand():
    column = pa.array(["Abc déf", None, "", "x abc abc", "déf"], pa.string())
    data, offsets = hashed.text_buffers(column)
    words = hashed.Words(data, offsets, (4,))
    assert words.text.tolist() == [0, 0, 3, 3, 3, 4]
    assert words.hashes[1] == words.hashes[5] and words.hashes[3] == words.hashes[4] != words.hashes[0]
    assert len(set(words.hashes.tolist())) == 4


def test_chunks_do_not_change_hashes(monkeypatch):
    text = ["some words in a row, again and again " * 50, "tail"]
    data, offsets = hashed.text_buffers(pa.array(text))
    whole = hashed.Words(data, offsets, (4, 5))
    monkeypatch.setattr(hashed, "CHUNK_BYTES", 64)
    parts = hashed.Words(data, offsets, (4, 5))
    assert (whole.hashes == parts.hashes).all() and (whole.text == parts.text).all()
    assert all((a == b).all() for a, b in zip(whole.heads, parts.heads))


def test_features_stay_inside_their_text():
    data, offsets = hashed.text_buffers(pa.array(["a b c", "d"]))
    features, owner = hashed.Words(data, offsets).features()
    assert np.bincount(owner).tolist() == [3 + 2 + 1, 1] and len(set(features.tolist())) == 7


def test_ftrl_follows_the_update_rule_and_stays_sparse():
    rows, targets = [np.array([1, 2]), np.array([2, 3]), np.array([1])] * 40, np.array([1.0, 0.0, 1.0] * 40)
    weights, bias = hashed.ftrl(rows, targets, 3, alpha=0.5, beta=1.0, l1=0.5, l2=0.1, epochs=2)
    z, n = dict.fromkeys(range(9), 0.0), dict.fromkeys(range(9), 0.0)

    def weight(i):
        if i == 8:
            return -z[i] / ((1.0 + n[i] ** 0.5) / 0.5)
        return 0.0 if abs(z[i]) <= 0.5 else -(z[i] - np.sign(z[i]) * 0.5) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)

    for _ in range(2):
        for row, target in zip(rows, targets):
            at = [*row.tolist(), 8]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - target
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
                n[i] += g * g
    assert weights == pytest.approx([weight(i) for i in range(8)]) and bias == pytest.approx(weight(8))
    assert weights[1] > 0 > weights[3] and (weights[[0, 4, 5, 6, 7]] == 0).all()


def test_learns_from_rows_that_are_not_held_out(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    result = toxicity.classify(documents, toxicity.fit(documents, labels)).toPandas()
    assert len(result) == documents.count() and result.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(result.doc_id, result.held_out))
    assert ((result.score >= 0.7) == (result.predicted == 1)).all()


def test_held_out_accuracy(spark):
    """Precision and recall on documents whose labels were never read."""
    folder = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    result = toxicity.classify(documents, toxicity.fit(documents, labels)).join(labels, "doc_id").toPandas()
    held = result[result.held_out]
    flagged, toxic = held.predicted == 1, held.toxic == 1
    assert toxic[flagged].mean() > 0.95 and flagged[toxic].mean() > 0.75


def test_labels_of_held_out_rows_change_nothing(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.is_held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    one, two = toxicity.fit(documents, labels), toxicity.fit(documents, turned)
    assert (one.buckets == two.buckets).all() and (one.weights == two.weights).all() and one.bias == two.bias


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (6, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    result = toxicity.classify(odd, model).toPandas()
    assert len(result) == 10 and result.score.notna().all()
    empty = result[result.doc_id.isin([3, 4, 5])].score
    assert empty.nunique() == 1
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    untrained = toxicity.fit(odd, labels.limit(0))
    assert set(toxicity.classify(odd, untrained).toPandas().score) == {0.5}
    assert toxicity.classify(nothing, model).count() == 0
    assert toxicity.fit(nothing, labels).bias == 0


def test_sample_has_its_bound(spark):
    rows = spark.range(10_000)
    taken = hashed.bounded_sample(rows, toxicity.F.xxhash64("id"), 1_000).count()
    assert 800 < taken < 1_200 and hashed.bounded_sample(rows, toxicity.F.xxhash64("id"), 10_000).count() == 10_000
