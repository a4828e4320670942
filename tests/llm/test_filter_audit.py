import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from wardline.llm import filter_audit
from wardline.llm.hashed import text_buffers

WORD = re.compile("[^\x20\x09-\x0d]+")


def _counts(text):
    words = WORD.findall(text or "")
    text = text or ""
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)]


def _transduced(texts):
    return filter_audit.text_counts(*text_buffers(pa.array(texts, pa.string()))).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab AZ\t\n\x00\x1f#|é中𝒳 "), max_size=40), max_size=8), st.integers(1, 30))
def test_counts_of_any_texts_and_pieces(texts, piece):
    whole = filter_audit.PIECE_BYTES
    try:
        filter_audit.PIECE_BYTES = piece
        assert _transduced(texts) == [_counts(t) for t in texts]
    finally:
        filter_audit.PIECE_BYTES = whole
    assert _transduced(texts) == [_counts(t) for t in texts]


def test_long_words_and_long_texts():
    texts = ["x" * 300 + " " + "x" * 300 + " " + "x" * 299 + "y", "中" * 900_000, "one two " * 300_000 + "ONE", None, ""]
    assert _transduced(texts) == [_counts(t) for t in texts]


def test_hash_hits_are_verified(monkeypatch):
    """With one hash for all words the table still tells them apart."""
    monkeypatch.setattr(filter_audit.Spans, "hashes", lambda self, words: np.zeros(len(words), np.uint64))
    texts = ["a b c a b c d", "a a a", "x y x aaaaaaaab aaaaaaaac aaaaaaaab"]
    assert _transduced(texts) == [_counts(t) for t in texts]


def _audit(docs, labels):
    """Every order applied to every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    failed = []
    for doc_id, text, lang in docs:
        n, distinct, capitals, symbols, points = _counts(text)
        tests = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * points, symbols > 0]
        tests.append(doc_id is not None and doc_id > first[text or ""])
        failed.append((lang or "", {f for f, hit in zip("ABCDE", tests) if hit}, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in failed}:
        own = [f[1:] for f in failed if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                here = [f for f in left if letter in f[0]]
                kept = [f for f in left if letter not in f[0]]
                all_failing = sum(letter in f[0] for f in own)
                alone = sum(f[0] == {letter} for f in own)
                out[part, order, step] = [
                    len(kept), len(here), all_failing - len(here) - 0, alone, sum(f[1] for f in here), sum(f[2] for f in here)
                ]
                # Failing ones that are still there later were not removed earlier, so the rest was.
                shapley[part, letter] += len(here)
                left = kept
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(220))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "de"), (3, long + " #", "en"), (4, "A" * 40, "en"), (5, "word " * 300, "de"),
        (6, None, None), (7, "", "en"), (None, long, "en"), (None, None, "de"), (8, long.upper(), ""), (9, "word " * 300, "de"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 0, 1), (5, 1, None), (9, None, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, n int")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.with_labels(filter_audit.failures(frame), said)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in found}
    assert got == _audit(docs, labels) and len(found) == len(got) == 3 * 600


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.with_labels(filter_audit.failures(odd), labels))
    assert found.count() == 600 and found.filter("good_lost + toxic_lost > 0").count() == 0
    assert filter_audit.audit(filter_audit.with_labels(filter_audit.failures(nothing), labels)).count() == 0


@pytest.mark.parametrize("letters", ["AB", "ABC"])
def test_any_number_of_filters(spark, letters):
    rows = spark.createDataFrame([("p", "A", 1, 0), ("p", "AB", 0, 1), ("p", "", 0, 0)], "part string, failed string, good int, toxic int")
    found = filter_audit.audit(rows, letters)
    assert found.count() == {"AB": 4, "ABC": 18}[letters]
    last = found.filter(f"step = {len(letters)}").select("kept").distinct().collect()
    assert [r[0] for r in last] == [1]
