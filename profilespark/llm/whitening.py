"""Embedding whitening: the leading principal components of the integer vectors, each scaled to variance one.

The distinct vectors are written once; a pass sums them exactly, a second one multiplies the centred vectors, and the d x d covariance
(d: the width of a vector) reaches the driver as d summed rows. There it is brought to tridiagonal form by Householder reflections, the
leading eigenvalues are bracketed by Sturm counts, and their vectors come from inverse iteration, kept orthogonal inside clusters of near
eigenvalues. The components, d numbers each, are sent to the rows, which are projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .vectors import column_sums, limbs, integer_vectors, rows_of, summed, whole

COMPONENTS, SCALE = 4, 256
EPS = float(np.finfo(float).eps)


# ---------------------------------------------------------------- the symmetric eigenproblem

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflectors of Q^T A Q; the i-th reflector acts on the coordinates from i + 1 on."""
    a = np.array(a, float)
    n, reflectors = len(a), []
    for i in range(n - 2):
        v = a[i + 1 :, i].copy()
        norm = np.linalg.norm(v)
        v[0] += norm if v[0] >= 0 else -norm
        length = np.linalg.norm(v)
        if length == 0:
            reflectors.append(np.zeros_like(v))
            continue
        v /= length
        p = a[i + 1 :, i + 1 :] @ v
        w = 2 * (p - v * (v @ p))
        a[i + 1 :, i + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[i + 1 :, i] -= 2 * v * (v @ a[i + 1 :, i])
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number of ``at``: the negative terms of its Sturm sequence."""
    below, q = np.zeros(len(at), int), np.ones(len(at))
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected to the last bits of the spectrum's size."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    size = max(abs(low), abs(high), np.finfo(float).tiny)
    least = max(EPS * EPS * size, np.finfo(float).tiny)
    lo, hi = np.full(k, low - EPS * size), np.full(k, high + EPS * size)
    rank = n - 1 - np.arange(k)  # the j-th largest has so many eigenvalues before it
    for _ in range(120):
        mid = (lo + hi) / 2
        right = count_below(diagonal, off, mid, least) <= rank
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
        if np.all(hi - lo <= EPS * np.maximum(np.abs(lo), EPS * size)):
            break
    return (lo + hi) / 2


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) z = b by elimination with row exchanges; a vanishing pivot becomes ``least``."""
    n = len(diagonal)
    d, up, up2, lower = diagonal - shift, np.append(off, 0.0), np.zeros(n), off
    z = b.copy()
    for i in range(n - 1):
        below, below_up = lower[i], up[i + 1]
        if abs(below) > abs(d[i]):
            d[i], below = below, d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            up2[i], below_up = below_up, 0.0
            z[i], z[i + 1] = z[i + 1], z[i]
        if abs(d[i]) < least:
            d[i] = least
        f = below / d[i]
        d[i + 1] -= f * up[i]
        up[i + 1] = below_up - f * up2[i]
        z[i + 1] -= f * z[i]
    if abs(d[-1]) < least:
        d[-1] = least
    for i in range(n - 1, -1, -1):
        z[i] = (z[i] - (up[i] * z[i + 1] if i + 1 < n else 0.0) - (up2[i] * z[i + 2] if i + 2 < n else 0.0)) / d[i]
    return z


def leading_vectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n, size = len(a), float(np.abs(a).max(initial=0.0))
    if not n or not size:
        return np.zeros(min(k, n)), np.eye(n)[:, : min(k, n)]
    k = min(k, n)
    diagonal, off, reflectors = tridiagonal((a + a.T) / 2 / size)
    values = leading_values(diagonal, off, k)
    norm = max(abs(values[0]), float(np.abs(diagonal).max()))
    rng, found = np.random.default_rng(11), np.zeros((n, k))
    for j in range(k):
        near = [i for i in range(j) if values[i] - values[j] <= 1e-3 * norm]
        z = rng.standard_normal(n)
        for _ in range(6):
            z = _solve_shifted(diagonal.copy(), off, values[j], z / np.abs(z).max(), EPS * norm)
            z /= np.linalg.norm(z)
            for _ in range(2):
                z -= found[:, near] @ (found[:, near].T @ z)
                z /= np.linalg.norm(z)
        found[:, j] = z
    for i in range(len(reflectors) - 1, -1, -1):
        found[i + 1 :] -= 2 * np.outer(reflectors[i], reflectors[i] @ found[i + 1 :])
    return values * size, found / np.linalg.norm(found, axis=0)


# ---------------------------------------------------------------- passes over the vectors

def _padded(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))


def _sum_pass(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    sums, n = [0] * width, 0
    for batch in batches:
        x = rows_of(batch.column(0), width)
        n += len(x)
        sums = [a + b for a, b in zip(sums, column_sums(x))] if len(x) else sums
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([limbs([*sums, n])], pa.list_(pa.int64()))], names=["k", "part"])


def _product_pass(batches: Iterator[pa.RecordBatch], centre: np.ndarray, turn: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (i, sums of the i-th column times every column, then its sum) of the centred and turned vectors of a task."""
    total = None
    for batch in batches:
        if batch.num_rows:
            y = rows_of(batch.column(0), len(centre)) - centre
            y = y if turn is None else y @ turn
            part = np.concatenate((y.T @ y, y.sum(axis=0)[:, None]), axis=1)
            total = part if total is None else total + part
    if total is not None:
        yield _matrix_rows(total, range(len(total)))


def _matrix_rows(rows, keys) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["i", "row"])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
            row = row.values.to_numpy()
            total[i] = total[i] + row if i in total else row.copy()
    if total:
        yield _matrix_rows(total.values(), total.keys())


def _products(fit: DataFrame, centre: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Sums of products of the centred vectors and, last, sums of the vectors; rows are added up by their number before they come here."""
    schema = "i int, row array<double>"
    partial = fit.mapInArrow(lambda b: _product_pass(b, centre, turn), schema)
    found = {r["i"]: r["row"] for r in partial.repartition("i").mapInArrow(_add_rows, schema).collect()}
    return np.array([found[i] for i in sorted(found)])


def _covariance(products: np.ndarray, n: int) -> np.ndarray:
    mean = products[:, -1] / n
    return products[:, :-1] / n - np.outer(mean, mean)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """sum (n x - S)^2 of every row, exact."""
    most = n * max(int(np.abs(x.astype(float)).max(initial=0)) + 1, 1) + max(map(abs, sums), default=0)
    if most * most * max(1, len(sums)) < 2**63:
        y = n * x - np.array(sums, np.int64)
        return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
    found = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 10**38 else None for v in found], pa.decimal128(38, 0))


def _project(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], centre: np.ndarray, turn: np.ndarray, explained: list[float], error: float) -> Iterator[pa.RecordBatch]:
    k = turn.shape[1]
    for batch in batches:
        x = rows_of(batch.column(1), len(centre))
        m, every = len(x), pa.array(np.repeat(np.arange(len(x)), k))
        y = (x - centre) @ turn
        columns = [batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), _deviation(x, n, sums).take(every),
                   pa.array(y.ravel()), pa.array(np.tile(np.array(explained, float), m)), pa.array(np.full(m * k, error))]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal(38,0)), whitened, explained and identity_error, one row per vector and component.

    A vector that is null or holds a null or non-finite component is dropped; ids may be null, repeated and of any type, and every row has
    its own rows in the result. Of vectors of several lengths the shorter read as if filled with zeros. The fit takes each distinct integer
    vector once. Components without variance beyond rounding are left out, so fewer than ``components`` come back where the vectors span
    less, and none where all vectors are equal, where there is one only, or where the table is empty. A deviation beyond 38 digits is null.
    """
    spark = vectors.sparkSession
    given = integer_vectors(vectors, scale, vec_id, embedding)
    kind = dict(given.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    width = given.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], schema)
    given = _padded(given, width)
    fit = cut(given.select("x").distinct())
    *sums, n = whole(summed(fit.mapInArrow(lambda b: _sum_pass(b, width), "k int, part array<long>"), "k", "part")[0])
    centre = np.array([s / n for s in sums])
    covariance = _covariance(_products(fit, centre), n)
    values, axes = leading_vectors(covariance, components)
    real = values > 64 * width * EPS * max(values[0], 0.0)
    if not real.any():
        return spark.createDataFrame([], schema)
    values, turn = values[real], axes[:, real] / np.sqrt(values[real])
    explained = (values / np.trace(covariance)).tolist()
    error = float(np.abs(_covariance(_products(fit, centre, turn), n) - np.eye(len(values))).max())
    return given.mapInArrow(lambda b: _project(b, n, sums, centre, turn, explained, error), schema)
