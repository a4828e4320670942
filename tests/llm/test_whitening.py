import math

import numpy as np
import pytest
from wardline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def _frame(spark, vectors):
    rows = [(i, v, 0, "x", "y") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def _grid(vectors):
    return [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]


def _expected(vectors, components=32):
    """Exact deviations by Python integers; eigenpairs by numpy from centred vectors."""
    x = _grid(vectors)
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centre = [s // n for s in sums]
    y = np.array([[a - c for a, c in zip(row, centre)] for row in x], float) - np.array([(s % n) / n for s in sums])
    values, basis = np.linalg.eigh(y.T @ y / n)
    return n, deviation, y, values[::-1][:components], basis[:, ::-1][:, :components], float((y * y).sum() / n)


def _check(spark, vectors, settings=whitening.Settings()):
    rows = whitening.whiten(_frame(spark, enumerate(vectors)), settings).collect()
    n, deviation, y, values, basis, trace = _expected(vectors, settings.components)
    white = np.zeros((n, len(values)))
    for r in rows:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-10)
        assert r["identity_error"] < 1e-10
    assert len(rows) == n * len(values)
    expected = y @ basis / np.sqrt(values)
    signs = np.sign((expected * white).sum(0))
    assert np.abs(white * signs - expected).max() < 1e-8
    assert np.abs(white.T @ white / n - np.eye(len(values))).max() < 1e-9


def test_more_dimensions_than_the_block(spark):
    random = np.random.default_rng(1)
    _check(spark, (random.standard_normal((400, 70)) * np.linspace(0.2, 2, 70) + 3).tolist())


def test_hot_vector_and_few_components(spark):
    random = np.random.default_rng(2)
    vectors = random.standard_normal((300, 12))
    vectors[:100] = vectors[0]
    _check(spark, vectors.tolist(), whitening.Settings(components=3, guard=2))


def test_fewer_dimensions_than_components(spark):
    _check(spark, np.random.default_rng(3).standard_normal((50, 5)).tolist())


def test_unusable_vectors_are_dropped(spark):
    good = [(i, [float(i % 5), float(i % 3)]) for i in range(30)]
    bad = [(90, None), (91, [1.0, None]), (92, [float("nan"), 1.0]), (93, [float("inf"), 1.0]), (94, []), (95, [1.0]), (None, [9.0, 9.0]), (3, [2.0, 7.0])]
    found = whitening.whiten(_frame(spark, good + bad)).collect()
    assert {r["n"] for r in found} == {32} and len(found) == 64
    assert sum(r["vec_id"] is None for r in found) == 2 and sum(r["vec_id"] == 3 for r in found) == 4


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        found = whitening.whiten(_frame(spark, vectors))
        assert found.count() == 0 and found.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_directions_without_variance_have_no_component(spark):
    vectors = [(i, [float(i), float(2 * i), 1.0]) for i in range(20)]
    found = whitening.whiten(_frame(spark, vectors)).collect()
    assert {r["component"] for r in found} == {1} and found[0]["explained"] == pytest.approx(1.0, rel=1e-10)


def test_filter_damps_and_the_bound_holds():
    """The recurrence equals the Chebyshev polynomial; the Lanczos bound is below the spectrum."""

    class Dense:
        def __init__(self, v):
            self.v, self.dimension = v, len(v)

        def __matmul__(self, block):
            return self.v @ block

    values = np.linspace(1, 9, 40)
    basis, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((40, 40)))
    dense = Dense(basis @ np.diag(values) @ basis.T)
    assert 0 <= whitening.lower_bound(dense, 10, np.random.default_rng(5)) <= 1
    low, high, top = 1.0, 5.0, 9.0
    filtered = basis.T @ whitening.chebyshev(dense, np.eye(40), 6, low, high, top) @ basis
    t = np.polynomial.chebyshev.Chebyshev([0] * 6 + [1])
    expected = t((values - 3) / 2) / t((top - 3) / 2)
    assert np.abs(np.diag(filtered) - expected).max() < 1e-12


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1_000_000, 1_000_064], [1_000_064, 1_000_000]])
    n = 10**9
    sums = (x.sum(0) * (n // 2)).tolist()
    assert whitening.deviations(x, n, np.array(sums)).to_pylist() == [None, None]
    n = 10**7
    sums = x.sum(0) * (n // 2)
    assert whitening.deviations(x, n, sums).to_pylist() == [2 * (32 * n) ** 2] * 2
