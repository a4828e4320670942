"""Terms found in numpy are those of the JVM expressions, whatever the slices."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.functions import terms
from wardline.operators import linear, tfidf

TEXTS = [
    "the cat sat", "the cat", "a b c", "", None, "中文 日本語 x中文", "𝒜𝒷 𐐀𐐁 zz", "ࡰࡱ one", "one\ntwo_2\x00two_2", "the cat sat " * 9,
    "ｆｕｌｌ 1² ½½", "one", "Été Straße ﬁn Σας", "the cat", "two_2 " * 4,
]
BOUNDS = {"min_df": 1, "max_df": 1.0}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i % 5, t) for i, t in enumerate(TEXTS)], "doc_id int, text string").coalesce(2)


def _by_term(docs):
    stats = tfidf.term_stats(tfidf.document_terms(docs, "doc_id"))
    return {(r["term"], r["df"], r["tf"]) for r in stats.collect()}


def _fitted(docs):
    return {(r["term"], r["df"], r["tf"]) for r in tfidf.fit_vocabulary(docs, "doc_id", **BOUNDS).collect()}


@pytest.mark.parametrize("chars", [1, 12, 1 << 20])
def test_counts_of_slices_are_those_by_term(docs, monkeypatch, chars):
    monkeypatch.setattr(terms, "SLICE_CHARS", chars)
    assert _fitted(docs) == _by_term(docs)


def test_a_term_has_one_row_a_slice(spark):
    """What is grouped afterwards are sums over the texts of a slice, not the terms of every text."""
    count = terms.counter(terms.word_points(spark))
    (rows,) = count([pa.RecordBatch.from_arrays([pa.array(["ab cd ab", "ab", None] * 1000)], ["folded"])])
    assert rows.num_rows == 4 and sorted(zip(rows["df"].to_pylist(), rows["tf"].to_pylist())) == [(1000, 1000), (1000, 1000), (1000, 1000), (2000, 3000)]


def test_words_that_share_a_hash_are_counted_by_term(docs, monkeypatch):
    monkeypatch.setattr(terms, "word_hashes", lambda words: np.full(len(words), 7, np.uint64))
    assert _fitted(docs) == _by_term(docs)


def test_more_candidates_than_tasks_hold_are_joined(docs, monkeypatch):
    monkeypatch.setattr(tfidf, "MAX_LOCAL_TERMS", 0)
    expected = _by_term(docs)
    assert _fitted(docs) == expected
    same = lambda tokens: (F.transform(tokens, lambda t: F.lit(7).cast("long")), lambda h: F.concat(h, F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))))
    monkeypatch.setattr(tfidf, "_token_hashes", same)
    assert _fitted(docs) == expected


@pytest.mark.parametrize("chars", [1, 1 << 20])
def test_margins_of_odd_texts(docs, monkeypatch, chars):
    monkeypatch.setattr(terms, "SLICE_CHARS", chars)
    names = sorted({t for t, _, _ in _by_term(docs)} - {"one", "cat sat"}) + ["", "no such term here"]
    rng = np.random.default_rng(1)
    model = linear.LinearTextModel(names, rng.random(len(names)) + 0.5, rng.normal(size=(len(names), 2)), [0.5, -1.0], ["x", "y"])
    keyed = docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    found = keyed.sparkSession.createDataFrame(
        [(n, i, float(model.vocabulary.idf[i])) for i, n in enumerate(names)], "term string, term_id int, idf double"
    )
    coefs = keyed.sparkSession.createDataFrame([(n, c, float(model.coefs[i, j])) for i, n in enumerate(names) for j, c in enumerate("xy")], "term string, label string, coefficient double")
    expected = {(r[0], r[1]): r[2] for r in linear.joined_scores(keyed, found, coefs, {"x": 0.5, "y": -1.0}, "doc_id").collect()}
    got = {(r[0], r[1]): r[2] for r in linear.linear_scores(keyed, model, "doc_id").collect()}
    assert set(got) == set(expected) and len(got) == 2 * len(TEXTS)
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)
