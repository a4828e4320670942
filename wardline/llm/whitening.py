"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. A pass over the vectors gives (1/n) XᵀXQ of the centred X for a block Q of a few
columns: every task multiplies its own rows and sends one dimension-by-columns matrix, the matrices are added up in a
shuffle by cell, and the driver receives their sum, whose size depends on the dimension alone. A few Lanczos passes
bound the spectrum from below; the three-term recurrence of a Chebyshev polynomial, one pass a degree, then damps the part
of the spectrum between that bound and the smallest Ritz value of the block and lets the rest grow; QR and Rayleigh-Ritz
follow. Rounds go on until every wanted eigenpair is certified by its residual |Vv - ev| <= tolerance * e1.

Defined results: vectors that are null or hold null or non-finite entries are dropped, and so are empty ones and those whose
length is not the most frequent one (of equal frequencies the longest). Of d dimensions at most min(d, 32) components are
returned; directions in which the data do not vary (eigenvalue <= 1e-10 of the largest) cannot be whitened and have none, so
a table of equal vectors, a single vector or an empty table gives no row. A component's sign is that of its entry of largest
size, made positive, the same for all rows; within an eigenspace of equal eigenvalues the basis is any. Repeated and null ids
are rows of their own. A deviation beyond the range of a long is null. Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

GRID, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Settings:
    components: int = 32
    guard: int = 16  # columns of the block beyond the components
    degree: int = 10  # of the Chebyshev polynomial
    lanczos: int = 10  # steps that bound the spectrum from below
    tolerance: float = 1e-13  # residual of a certified eigenpair, relative to the largest eigenvalue
    rounds: int = 60  # an error beyond these
    seed: int = 7


@dataclass(frozen=True)
class Moments:
    """Exact count and sums of the fit list, and the centre split so that x - centre - rest loses no digits."""

    n: int
    sums: list[int]

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])


def grid_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, the whole numbers of the usable vectors, written to the shared folder."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * GRID) + SHIFT)
    rows = embeddings.select(F.col(key).alias("vec_id"), F.col(vector).alias(vector)).filter((F.size(vector) > 0) & usable)
    rows = materialize(rows.select("vec_id", x.alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.orderBy(F.col("rows").desc(), F.col("length").desc()).first()
    return rows.filter(F.size("x") == (common["length"] if common else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a batch of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(vectors: DataFrame) -> Moments | None:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = matrix(batch.column(0)).sum(0)
                counts = np.full(len(sums), batch.num_rows, np.int64)
                dims = np.arange(len(sums), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(counts), pa.array(sums)], ["dim", "n", "total"])

    parts = vectors.select("x").mapInArrow(add, "dim int, n long, total long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # one row a dimension
    by_dim = {row["dim"]: row for row in found}
    return Moments(by_dim[0]["n"], [by_dim[i]["total"] for i in range(len(by_dim))]) if by_dim else None


class Covariance:
    """Products of the covariance matrix with blocks of columns, each one pass over the vectors."""

    def __init__(self, vectors: DataFrame, of: Moments):
        self.vectors, self.of, self.passes = vectors.select("x"), of, 0
        self.dimension = len(of.sums)
        #: Sum of the variances; known after the first pass.
        self.trace = 0.0

    def __matmul__(self, block: np.ndarray) -> np.ndarray:
        centre, rest, columns = self.of.centre, self.of.rest, block.shape[1]

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = (matrix(batch.column(0)) - centre) - rest
                    part = np.column_stack([x.T @ (x @ block), (x * x).sum(0)])
                    total = part if total is None else total + part
            if total is not None:
                cells = pa.array(np.arange(total.size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], ["cell", "value"])

        parts = self.vectors.mapInArrow(multiply, "cell int, value double")
        sums = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()  # dimension x (columns + 1) numbers
        found = np.zeros(self.dimension * (columns + 1))
        found[sums["cell"].to_numpy()] = sums["value"].to_numpy()
        found = found.reshape(self.dimension, -1) / self.of.n
        self.passes += 1
        self.trace = float(found[:, -1].sum())
        return found[:, :-1]


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column a component
    residual: float
    trace: float
    passes: int


def lower_bound(covariance: Covariance, steps: int, random: np.random.Generator) -> float:
    """A bound below the smallest eigenvalue: a few Lanczos steps, less the norm of what they leave."""
    v = random.standard_normal((covariance.dimension, 1))
    basis, alphas, betas = [v / np.linalg.norm(v)], [], []
    for _ in range(min(steps, covariance.dimension)):
        w = covariance @ basis[-1]
        alphas.append((basis[-1].T @ w).item())
        known = np.hstack(basis)
        for _ in range(2):  # full orthogonalisation, twice for its rounding
            w = w - known @ (known.T @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(alphas[0], 1e-300):
            break
        basis.append(w / betas[-1])
    size = len(alphas)
    tridiagonal = np.diag(alphas) + np.diag(betas[: size - 1], 1) + np.diag(betas[: size - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(tridiagonal)[0]) - betas[-1])


def chebyshev(covariance: Covariance, block: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The block under the Chebyshev polynomial that stays within 1 on [low, high], scaled to about 1 at ``top``."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = half / (top - middle)
    first = sigma
    previous, block = block, (covariance @ block - middle * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        previous, block = block, (covariance @ block - middle * block) * (2 * following / half) - (sigma * following) * previous
        sigma = following
    return block


def leading_pairs(covariance: Covariance, settings: Settings = Settings()) -> Spectrum:
    """The largest eigenvalues with unit eigenvectors, every pair certified by its residual."""
    random = np.random.default_rng(settings.seed)
    wanted = min(settings.components, covariance.dimension)
    block = random.standard_normal((covariance.dimension, min(wanted + settings.guard, covariance.dimension)))
    low = None
    for _ in range(settings.rounds):
        block, _ = np.linalg.qr(block)
        image = covariance @ block
        reduced = block.T @ image
        values, turn = np.linalg.eigh((reduced + reduced.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = max(values[0], 0.0)
        residual = float(np.linalg.norm(image - block * values, axis=0)[:wanted].max())
        if residual <= settings.tolerance * top or top == 0:
            found = block[:, :wanted]
            signs = np.sign(found[np.abs(found).argmax(0), np.arange(wanted)])
            return Spectrum(values[:wanted], found * signs, residual, covariance.trace, covariance.passes)
        if low is None:
            low = lower_bound(covariance, settings.lanczos, random)
        high = max(values[-1], low + 1e-9 * top, 1e-9 * top)
        block = chebyshev(covariance, block, settings.degree, min(low, 0.999 * high), high, top)
    raise RuntimeError(f"no certificate after {settings.rounds} rounds: residual {residual:g} of eigenvalue {top:g}")


def identity_error(covariance: Covariance, transform: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, by one more pass."""
    found = transform.T @ (covariance @ transform)
    return float(np.abs(found - np.eye(transform.shape[1])).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums of (n*x - S)^2; null beyond a long."""
    y = n * x - sums
    peak = int(np.abs(y).max(initial=0))
    if peak * peak * x.shape[1] < 1 << 63:
        return pa.array((y * y).sum(1))
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def project(vectors: DataFrame, of: Moments, transform: np.ndarray) -> DataFrame:
    """vec_id, deviation, whitened (all components of a vector as an array)."""
    centre, rest, sums, n, width = of.centre, of.rest, np.array(of.sums, np.int64), of.n, transform.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                white = ((x - centre) - rest) @ transform
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), deviations(x, n, sums), lists], ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "x").mapInArrow(rows, f"vec_id {kind}, deviation long, whitened array<double>")


def whiten(embeddings: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    More columns: eigenvalue and residual of the certificate.
    """
    vectors = grid_vectors(embeddings, key, vector)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    of = moments(vectors)
    columns = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, residual double"
    nothing = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {columns}")
    if of is None:
        return nothing
    covariance = Covariance(vectors, of)
    found = leading_pairs(covariance, settings)
    varying = int((found.values > 1e-10 * max(found.values[0], 0.0)).sum()) if found.values[0] > 0 else 0
    if not varying:
        return nothing
    values = found.values[:varying]
    transform = found.vectors[:, :varying] / np.sqrt(values)
    error = identity_error(covariance, transform)

    def by_component(numbers: np.ndarray) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in numbers]), F.col("component") - 1)

    rows = project(vectors, of, transform).select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.withColumn("component", F.col("pos") + 1).select(
        "vec_id",
        "component",
        F.lit(of.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        by_component(values / found.trace).alias("explained"),
        F.lit(error).alias("identity_error"),
        by_component(values).alias("eigenvalue"),
        F.lit(found.residual).alias("residual"),
    )
