"""Operator 13: PCA whitening of embeddings from a distributed covariance and a symmetric eigensolver of its own.

Spark counts, sums and multiplies in two passes; what reaches the driver is one matrix of the vectors' dimension.
There it is brought to tridiagonal form by Householder reflections; Sturm counts bisect the leading eigenvalues;
inverse iteration gives their vectors, made orthogonal within clusters of close values.  The components go out as a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

ROWS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
#: Entries are whole numbers below this, so that a task's sums of 2**20 rows and more stay exact in 64 bits.
LARGEST = 1 << 42


def householder(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix; row ``k`` of the last is the unit normal of reflection ``k``."""
    a = np.array(matrix, np.float64)
    d = len(a)
    normals = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        if size == 0 or not np.any(x[1:]):
            continue
        v /= size
        normals[k, k + 1 :] = v
        w = a[:, k + 1 :] @ v
        half = v @ w[k + 1 :]
        w[k + 1 :] -= half * v
        a[:, k + 1 :] -= 2 * np.outer(w, v)
        a[k + 1 :, :] -= 2 * np.outer(v, w)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), normals


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each ``x``: the negative pivots of its Sturm sequence."""
    tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    below = np.zeros(len(x), np.int64)
    pivot = np.ones(len(x))
    for i, a in enumerate(diagonal):
        pivot = (a - x) - ((off[i - 1] ** 2) / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, bisected together until an interval is as narrow as doubles allow."""
    d = len(diagonal)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    spread = max(abs(low[0]), abs(high[0]))
    low, high = low - 1e-15 * spread, high + 1e-15 * spread
    wanted = d - 1 - np.arange(k)  # the value with this many below it
    while True:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= 1e-17 * spread)):
            return middle
        above = count_below(diagonal, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """The solution of (T - shift) x = right by elimination with row exchanges; vanishing pivots count as ``least``."""
    d = len(diagonal)
    main, up, up2, x = diagonal - shift, np.append(off, 0.0), np.zeros(d), right.copy()
    low = np.append(off, 0.0)
    for i in range(d - 1):
        if abs(main[i]) < abs(low[i]):
            main[i], low_i = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        else:
            low_i = low[i]
        main[i] = main[i] if abs(main[i]) > least else least
        factor = low_i / main[i]
        main[i + 1] -= factor * up[i]
        up[i + 1] -= factor * up2[i]
        x[i + 1] -= factor * x[i]
    main[-1] = main[-1] if abs(main[-1]) > least else least
    for i in range(d - 1, -1, -1):
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < d else 0.0) - (up2[i] * x[i + 2] if i + 2 < d else 0.0)) / main[i]
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, gap: float = 1e-3, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (rows) of the tridiagonal matrix; values closer than ``gap`` of its norm are one cluster."""
    d = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    least = np.finfo(np.float64).eps * norm
    draws = np.random.default_rng(13)
    found: list[np.ndarray] = []
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > gap * norm:
            first = i
        # Values of a cluster that are alike are moved apart by a rounding step, else the iterations would meet.
        shift = value - (i - first) * 2 * least
        x = draws.standard_normal(d)
        for _ in range(rounds):
            x = _solved(diagonal, off, shift, x / np.linalg.norm(x), least)
            for _ in range(2):
                for other in found[first:]:
                    x -= (other @ x) * other
        found.append(x / np.linalg.norm(x))
    return np.array(found).reshape(len(values), d)


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors (rows); values that rounding cannot tell from zero go."""
    d = len(covariance)
    trace = float(np.trace(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((0, d))
    scaled = (covariance + covariance.T) / (2 * trace)
    diagonal, off, normals = householder(scaled)
    values = leading_values(diagonal, off, min(k, d))
    values = values[values > 64 * d * np.finfo(np.float64).eps]
    vectors = inverse_iteration(diagonal, off, values)
    for v in normals[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    # One Rayleigh quotient sharpens each value to the vector's accuracy squared.
    return np.einsum("ij,jk,ik->i", vectors, scaled, vectors) * trace, vectors


def _whole_vectors(batches: Iterator[pa.RecordBatch], scale: int, shift: int) -> Iterator[tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """For each batch its ids and, by dimension, row numbers and integer vectors of the rows without null or non-finite entries."""
    for batch in batches:
        lists = batch.column(1)
        sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        bad = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(~np.isfinite(flat), out=bad[1:])
        fine = (sizes > 0) & (bad[starts + np.maximum(sizes, 0)] == bad[starts])
        parts = {}
        for d in np.unique(sizes[fine]).tolist():
            rows = np.flatnonzero(fine & (sizes == d))
            x = np.floor(scale * flat[starts[rows, None] + np.arange(d)]) + shift
            if np.abs(x).max() >= LARGEST:
                raise ValueError(f"an entry is beyond {LARGEST} after scaling")
            parts[d] = rows, x.astype(np.int64)
        yield batch.column(0), parts


def _sums(scale: int, shift: int) -> Callable:
    def run(batches):
        total: dict[int, list] = {}
        for _, parts in _whole_vectors(batches, scale, shift):
            for d, (_, x) in parts.items():
                n, s = total.get(d, (0, 0))
                total[d] = n + len(x), s + x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"d": [*total], "n": [n for n, _ in total.values()], "s": [s.tolist() for _, s in total.values()]}, schema=pa.schema([("d", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    return run


def _products(batches, shared, scale: int, shift: int, vectors_of: Callable):
    """Rows of the sums of outer products of centred (and then mapped) vectors, one matrix a task and dimension."""
    total: dict[int, np.ndarray] = {}
    for _, parts in _whole_vectors(batches, scale, shift):
        for d, (_, x) in parts.items():
            y = vectors_of(shared.value[d], x)
            total[d] = total.get(d, 0) + y.T @ y
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])
    for d, m in total.items():
        yield pa.RecordBatch.from_pydict({"d": [d] * len(m), "i": list(range(len(m))), "row": m.tolist()}, schema=schema)


def _matrices(rows: DataFrame) -> dict[int, np.ndarray]:
    """The summed matrices, by dimension: partial sums in the map tasks, then one row of numbers a matrix row."""
    summed = rows.groupBy("d", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    out: dict[int, list] = {}
    for r in summed.orderBy("d", "i").collect():
        out.setdefault(r["d"], []).append(r["row"])
    return {d: np.array(m) for d, m in out.items()}


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """``x - s / n`` in doubles, from whole quotients and exact rests."""
    whole, rest = np.divmod(s, n)
    return (x - whole) - rest / n


def _deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """Exact sums of (n * x - s)²; what 64 bits cannot hold raises."""
    whole, rest = np.divmod(s, n)
    most = (int(np.abs(x - whole).max(initial=0)) + 1) * n
    if most * most * len(s) < 1 << 63:
        y = (x - whole) * n - rest
        return (y * y).sum(axis=1)
    y = (x - whole).astype(object) * n - rest.astype(object)
    out = (y * y).sum(axis=1)
    if max(out) >= 1 << 63:
        raise OverflowError("a deviation exceeds 64 bits")
    return out.astype(np.int64)


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): whitened coordinates, one row a vector and component.

    Entries become whole numbers ``x = floor(scale * c) + shift``.  Fitted on all vectors: count n, sums S, covariance V of the
    centred entries with divisor n.  ``whitened`` is the projection of ``x - S / n`` on the component over the root of its eigenvalue,
    ``explained`` the eigenvalue's share of V's trace, ``deviation`` the exact sum of (n * x - S)², ``identity_error`` the
    largest deviation of the whitened vectors' measured covariance from the identity.

    Vectors that are null, empty, or hold null or non-finite entries take no part.  Each dimension that occurs is fitted by
    itself.  Components whose eigenvalue rounding cannot tell from zero are left out, so a table of equal vectors gives no
    rows, nor does an empty one.  Equal eigenvalues have any orthonormal basis of their space.  Repeated rows and null ids
    are kept, other columns are not read.  To the driver go one count and sum vector and two matrices (d x d, k x k) for each
    dimension d, to the tasks d x k numbers: bounded by the dimensions, not by the rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sums = rows.mapInArrow(_sums(scale, shift), "d int, n bigint, s array<bigint>")
    places = sums.select("d", "n", F.posexplode("s").alias("i", "x")).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    fits: dict[int, tuple[int, list]] = {}
    for r in places.orderBy("d", "i").collect():
        fits.setdefault(r["d"], (r["n"], []))[1].append(r["x"])
    fits = {d: (n, np.array(s, np.int64)) for d, (n, s) in fits.items()}

    centre = spark.sparkContext.broadcast(fits)
    cells = "d int, i int, row array<double>"
    covariance = _matrices(rows.mapInArrow(lambda it: _products(it, centre, scale, shift, lambda fit, x: _centred(x, *fit)), cells))
    models = {}
    for d, (n, s) in fits.items():
        values, components = leading_components(covariance[d] / n, k)
        models[d] = n, s, values / (np.trace(covariance[d]) / n or 1.0), components.T / np.sqrt(values)
    model = spark.sparkContext.broadcast(models)
    measured = _matrices(rows.mapInArrow(lambda it: _products(it, model, scale, shift, lambda m, x: _centred(x, m[0], m[1]) @ m[3]), cells))
    errors = {d: float(np.abs(c / fits[d][0] - np.eye(len(c))).max(initial=0.0)) for d, c in measured.items()}

    def project(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
        for ids, parts in _whole_vectors(batches, scale, shift):
            for d, (at, x) in parts.items():
                n, s, explained, maps = model.value[d]
                m = maps.shape[1]
                if m:
                    each = [ids.take(pa.array(np.repeat(at, m))), np.tile(np.arange(1, m + 1, dtype=np.int32), len(at)), np.full(len(at) * m, n), np.repeat(_deviations(x, n, s), m)]
                    each += [(_centred(x, n, s) @ maps).ravel(), np.tile(explained, len(at)), np.full(len(at) * m, errors[d])]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in each], schema=schema)

    return rows.mapInArrow(project, ROWS)
