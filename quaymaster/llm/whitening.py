"""Embedding whitening: Chebyshev-filtered subspace iteration over distributed products with the covariance.

The covariance is never formed. A pass over the fitted vectors gives its product with a
narrow block Q, as the sum over tasks of (x - mean)^T ((x - mean) Q). A few Lanczos steps bound the
spectrum; a Chebyshev polynomial of such products then damps the part of the spectrum that
is not wanted, QR makes the block orthonormal again and Rayleigh-Ritz turns it to the
eigenvectors, until the residuals certify them. Between passes the driver holds only
dimension x block numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaymaster.llm.common import struct, written

COMPONENTS = 16
GUARD = 32  # columns of the block beyond the wanted ones; they widen the gap that the filter works on
BLOCK_ROWS = 1 << 12
LANCZOS_STEPS = 12
MOST_DEGREE = 16
MOST_ROUNDS = 100
SPREAD = 1e8  # a filter raises the largest eigenvalue over the least wanted one by no more than this
TOLERANCE = 2e-15  # residual certified at once, as a share of the largest eigenvalue
LEAST_CERTIFIED = 1e-11  # residuals that no longer shrink are certified below this share
LEAST_EIGENVALUE = 1e-11  # smaller shares of the largest eigenvalue are directions without variance
SCALE = 64
LARGEST = 2.0 ** 56  # entries from here on have no long
HALF = 31  # exact sums are kept in two halves of this many bits


@dataclass(frozen=True)
class Whitening:
    """Leading eigenvectors (dimensions x components) of the covariance of ``n`` different vectors."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    @property
    def components(self) -> int:
        return len(self.values)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, shift: int = 0) -> DataFrame:
    """(id, x): entries times 64, rounded down, plus ``shift``.

    Null vectors and those that hold null or non-finite entries, or entries of 2**56 and more, which have no
    long, go; so do empty vectors, and vectors that are not as long as most are (:func:`usual_length`).
    """
    vector = F.col(vector_col)
    usable = F.coalesce(F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST), F.lit(False))), F.lit(False))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(shift).cast("long"))
    rows = df.select(F.col(id_col).alias("id"), F.when(usable & (F.size(vector) > 0), x).alias("x")).filter("x is not null")
    return rows.filter(F.size("x") == usual_length(rows))


def usual_length(rows: DataFrame) -> int:
    """The length that most vectors have (the smaller of equally frequent ones); 0 without vectors."""
    first = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return first["d"] if first else 0


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[np.ndarray]:
    """The vectors of a batch as rows, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _numbered(total: np.ndarray) -> pa.RecordBatch:
    flat = total.ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["place", "value"])


def _summed(vectors: DataFrame, shape: tuple[int, ...], each) -> np.ndarray:
    """Sum over all vectors of ``each(rows)``: one array a task, added up by Spark place by place."""
    def run(batches):
        total = np.zeros(shape)
        for rows in _matrices(batches):
            total += each(rows)
        yield _numbered(total)

    sums = vectors.mapInArrow(run, struct("place int, value double")).groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return out.reshape(shape)


def exact_sums(vectors: DataFrame, dimensions: int) -> tuple[int, ...]:
    """Sum per dimension, exact whatever the size of the entries."""
    def run(batches):
        total = np.zeros((2, dimensions), np.int64)
        for rows in _matrices(batches):
            total += np.stack([(rows >> HALF).sum(axis=0), (rows & (1 << HALF) - 1).sum(axis=0)])
        yield _numbered(total)

    sums = vectors.mapInArrow(run, struct("place int, value long")).groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    halves = {r["place"]: int(r["value"]) for r in sums}
    return tuple((halves.get(j, 0) << HALF) + halves.get(dimensions + j, 0) for j in range(dimensions))


def centred(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """rows - sums / n, from n * rows - sums in whole numbers where a long holds them."""
    return deviations(rows, n, sums).astype(np.float64) / n


def deviations(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * rows - sums, exact: longs, or Python integers where longs are too small."""
    most = max((abs(s) for s in sums), default=0) + n * int(np.abs(rows).max(initial=0))
    if most < 1 << 62:
        return n * rows - np.array(sums, np.int64)
    return n * rows.astype(object) - np.array(sums, object)


def squared_lengths(rows: np.ndarray) -> list[int]:
    """Sum of squares per row of whole numbers, exact."""
    if rows.dtype != object:
        most = int(np.abs(rows).max(initial=0))
        if most * most * rows.shape[1] < 1 << 63:
            return (rows * rows).sum(axis=1).tolist()
    return (rows.astype(object) ** 2).sum(axis=1).tolist()


class _Covariance:
    """Products of the covariance with a block of columns: one distributed pass each."""

    def __init__(self, vectors: DataFrame, n: int, sums: tuple[int, ...]):
        self.vectors, self.n, self.sums, self.passes = vectors, n, sums, 0

    def times(self, block: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums
        shared = self.vectors.sparkSession.sparkContext.broadcast(block)  # dimensions x block

        def each(rows):
            x = centred(rows, n, sums)
            return x.T @ (x @ shared.value)

        self.passes += 1
        product = _summed(self.vectors, block.shape, each) / n
        shared.unpersist()
        return product

    def trace(self) -> float:
        n, sums = self.n, self.sums
        self.passes += 1
        return float(_summed(self.vectors, (1,), lambda rows: (centred(rows, n, sums) ** 2).sum(keepdims=True)[0])[0]) / n


def _lanczos_bounds(covariance: _Covariance, dimensions: int, rng: np.random.Generator, steps: int) -> tuple[float, float]:
    """(about the least, at least the largest) eigenvalue from a short Lanczos run with full orthogonalisation."""
    basis = np.zeros((dimensions, 0))
    q = rng.standard_normal(dimensions)
    q /= np.linalg.norm(q)
    diagonal, beside = [], []
    for _ in range(min(steps, dimensions)):
        basis = np.column_stack([basis, q])
        v = covariance.times(q[:, None])[:, 0]
        diagonal.append(q @ v)
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        beside.append(np.linalg.norm(v))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            beside[-1] = 0.0
            break
        q = v / beside[-1]
    ritz = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return float(max(ritz[0], 0.0)), float(ritz[-1] + beside[-1])


def _filter_degree(low: float, high: float, largest: float, wanted: float) -> int:
    """Degree at which the largest eigenvalue outgrows the least wanted one by ``SPREAD`` at most."""
    centre, half = (low + high) / 2, (high - low) / 2
    growth = np.arccosh(max((largest - centre) / half, 1.0)) - np.arccosh(max((wanted - centre) / half, 1.0))
    return int(np.clip(np.log(SPREAD) / max(growth, 1e-3), 2, MOST_DEGREE))


def _filtered(covariance: _Covariance, block: np.ndarray, image: np.ndarray, low: float, high: float, degree: int) -> np.ndarray:
    """Chebyshev polynomial of the covariance, small on [low, high], times ``block``, of which ``image`` is the product."""
    centre, half = (low + high) / 2, (high - low) / 2
    before, now = block, (image - centre * block) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (covariance.times(now) - centre * now) / half - before
        # A common factor keeps the numbers in range; the recurrence is linear.
        size = np.abs(now).max()
        if size > 1e100:
            before, now = before / size, now / size
    return now


def fit(vectors: DataFrame, components: int = COMPONENTS, guard: int = GUARD, seed: int = 0) -> Whitening:
    """Leading ``components`` eigenvectors of the covariance (divisor n) of the rows of ``vectors`` (x: whole numbers, one length).

    Fewer where fewer directions have variance: eigenvalues of at most 1e-11 of the largest count as
    none. The block starts at random from ``seed``. Iteration ends when every wanted residual is 2e-15 of the
    largest eigenvalue, or when they no longer shrink and are below 1e-11; it raises
    if neither comes about.
    """
    n = vectors.count()
    dimensions = len(vectors.first()["x"]) if n else 0
    sums = exact_sums(vectors, dimensions) if n else ()
    covariance = _Covariance(vectors, n, sums)
    trace = covariance.trace() if n else 0.0
    if not trace > 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((dimensions, 0)), 0.0, np.zeros(0), covariance.passes)
    rng = np.random.default_rng(seed)
    width = min(dimensions, components + guard)
    wanted = min(components, dimensions)
    low = _lanczos_bounds(covariance, dimensions, rng, LANCZOS_STEPS)[0] if width < dimensions else 0.0
    block = np.linalg.qr(rng.standard_normal((dimensions, width)))[0]
    best = np.inf
    for _ in range(MOST_ROUNDS):
        image = covariance.times(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        real = values[:wanted] > LEAST_EIGENVALUE * values[0]
        residuals = np.linalg.norm(image - block * values, axis=0)[:wanted]
        worst = float(residuals[real].max()) / values[0]
        if worst <= TOLERANCE or width == dimensions or (worst <= LEAST_CERTIFIED and worst > best / 2):
            keep = int(real.sum())
            return Whitening(n, sums, values[:keep], block[:, :keep], trace, residuals[:keep], covariance.passes)
        best = min(best, worst)
        least = max(values[wanted - 1], LEAST_EIGENVALUE * values[0])
        # The guard's least Ritz value ends the damped part; without variance there, any small positive end will do.
        high = max(values[-1], 1e-3 * least)
        start = min(low, 0.999 * high)
        block = np.linalg.qr(_filtered(covariance, block, image, start, high, _filter_degree(start, high, values[0], least)))[0]
    raise RuntimeError(f"residual {worst:.3g} of the largest eigenvalue after {MOST_ROUNDS} filters")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened ``vectors`` minus the identity."""
    k = model.components
    if not k:
        return 0.0
    n, sums, axes = model.n, model.sums, model.vectors / np.sqrt(model.values)

    def each(rows):
        w = centred(rows, n, sums) @ axes
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _summed(vectors, (k + 1, k), each) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) of ``rows`` (id, x): exact squared length of n*x - S, and one number a component."""
    id_type = rows.schema["id"].dataType.simpleString()
    n, sums, k = model.n, model.sums, model.components
    shared = rows.sparkSession.sparkContext.broadcast(model.vectors / np.sqrt(model.values) if k else model.vectors)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                exact = deviations(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), n, sums)
                w = (exact.astype(np.float64) / n) @ shared.value
                offsets = pa.array(np.arange(part.num_rows + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(map(str, squared_lengths(exact)), pa.string()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                    names=["id", "deviation", "whitened"])

    out = rows.mapInArrow(run, struct(f"id {id_type}, deviation string, whitened array<double>"))
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, shift: int = 0) -> DataFrame:
    """(id_col, n, deviation, whitened, explained, identity_error): fit on the different vectors, apply to every row.

    Entries are taken times 64, rounded down, plus ``shift``, so that equal vectors are told exactly. Vectors that are null, empty, of another length than most, or hold
    null or non-finite entries take no part; repeated rows are whitened each and fitted once. ``whitened``
    and ``explained`` have one entry a component, at most ``components``, by falling eigenvalue; directions without variance are
    no components, so one different vector gives empty lists. ``deviation`` is a decimal of 38
    digits, null beyond. An empty table gives an empty result. Only the two named columns are read.
    """
    rows = whole_vectors(df, id_col, vector_col, shift)
    fitted = written(rows.select("x").distinct(), "whitening-fit")
    model = fit(fitted, components)
    explained = [float(v) / model.trace for v in model.values]
    return transform(rows, model).select(
        F.col("id").alias(id_col), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        _doubles(explained).alias("explained"), F.lit(identity_error(fitted, model)).alias("identity_error"))


def _doubles(values: list[float]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<double>")
