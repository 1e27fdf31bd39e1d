"""Embedding whitening with components found by FEAST contour integration.

Spark sums the covariance of all distinct vectors; the eigenproblem of that one matrix, whose size is the vectors' width,
is solved by projecting onto eigenvalue intervals: complex shifted solves at the nodes of a quadrature around an interval
filter a few random directions, Rayleigh-Ritz takes the components out of what passes, and inertia counts say how many
there must be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm._common import Stash, carried

#: Entries per unit: vectors are compared and summed as whole numbers of 1/256.
SCALE = 256
#: Widest vectors: the covariance stands in the driver and, as partial sums, in each task.
MOST_WIDTH = 2048
#: Eigenvalues of one interval, and quadrature nodes on its half circle.
IN_INTERVAL, NODES = 8, 16
#: Eigenvalues below this share of the largest are rounding errors: there is no such component.
LEAST_SHARE = 1e-12
#: Eigenvalues nearer than this share of the largest are not parted.
LEAST_GAP = 1e-11
_LONG = 2**63


class Spectrum(NamedTuple):
    """Eigenvalues in falling order and their unit vectors as columns."""

    values: np.ndarray
    vectors: np.ndarray


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of v (Householder's reflections)."""
    a, d = v.astype(np.float64, copy=True), len(v)
    off = np.zeros(max(d - 1, 0))
    for k in range(d - 1):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        off[k] = length
        if k == d - 2 or length == 0:
            off[k] = abs(x[0]) if k == d - 2 else 0.0
            continue
        u = x.copy()
        u[0] += np.copysign(length, x[0])
        u /= np.linalg.norm(u)
        p = a[k + 1 :, k + 1 :] @ u
        w = p - (u @ p) * u
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, w) + np.outer(w, u))
    return np.diag(a).copy(), off


def counts_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia: how many eigenvalues exceed each shift, by the signs of the pivots of the shifted tridiagonal matrix."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = np.ones_like(shifts)
    above = np.zeros(len(shifts), np.int64)
    for k, x in enumerate(diagonal):
        pivot = x - shifts - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        above += pivot > 0
    return above


def _kth(count: Callable[[np.ndarray], np.ndarray], k: int, lo: float, hi: float) -> float:
    """The k-th largest eigenvalue, between lo and hi, by counts at 32 shifts at a time."""
    for _ in range(16):
        shifts = np.linspace(lo, hi, 34)[1:-1]
        enough = np.flatnonzero(count(shifts) >= k)
        new = (shifts[enough[-1]] if len(enough) else lo, shifts[enough[-1] + 1] if len(enough) and enough[-1] + 1 < len(shifts) else (hi if len(enough) else shifts[0]))
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def _interval(v: np.ndarray, low: float, high: float, n: int, rng: np.random.Generator) -> Spectrum:
    """The n eigenpairs between low and high. The search space grows until Rayleigh-Ritz finds as many as the count says."""
    d, scale = len(v), np.abs(v).sum(axis=1).max()
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (nodes + 1))
    middle, radius = (low + high) / 2, (high - low) / 2
    width = min(d, n + n // 2 + 4)
    while True:
        q = rng.standard_normal((d, width))
        best, best_error, worse = None, np.inf, 0
        for _ in range(200):
            if width < d:
                passed = np.zeros_like(q)
                for t, weight in zip(turn, weights):
                    passed += weight / 2 * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(d) - v, q.astype(complex))).real
                q = passed
            q = np.linalg.qr(q)[0]
            values, small = np.linalg.eigh((q.T @ v @ q + (q.T @ v @ q).T) / 2)
            q = q @ small
            inside = (values > low) & (values < high)
            error = np.inf if inside.sum() != n else np.linalg.norm(v @ q[:, inside] - q[:, inside] * values[inside], axis=0).max()
            if error < best_error / 2:
                worse = 0
            else:
                worse += 1
            if error < best_error:
                best, best_error = Spectrum(values[inside], q[:, inside]), error
            if width == d or best_error <= 1e-15 * scale or worse > (3 if best_error < 1e-11 * scale else 30):
                break
        if best is not None and (best_error < 1e-11 * scale or width == d):
            return best
        if width == d:
            raise ArithmeticError(f"no {n} eigenvalues between {low} and {high}")
        width = min(d, 2 * width)


def feast(v: np.ndarray, k: int, *, seed: int = 0) -> Spectrum:
    """The k largest eigenvalues of a covariance matrix and their vectors; fewer where the others are zero up to rounding.

    Intervals of about IN_INTERVAL eigenvalues each end in gaps of the spectrum, which counts find; equal eigenvalues
    stay together. The largest entry of a vector is positive.
    """
    d = len(v)
    none = Spectrum(np.zeros(0), np.zeros((d, 0)))
    if not d or not np.any(v):
        return none
    diagonal, off = tridiagonal(v)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    margin = 1e-12 * max(abs(low), abs(high))
    low, high = low - margin, high + margin
    count = lambda shifts: counts_above(diagonal, off, shifts)
    largest = _kth(count, 1, low, high)
    k = min(k, int(count(np.array([LEAST_SHARE * largest]))[0]))
    known: dict[int, float] = {0: high, d + 1: low}
    value = lambda j: known.setdefault(j, _kth(count, j, low, high))
    found, done, rng = [], 0, np.random.default_rng(seed)
    upper = high
    while done < k:
        end = min(done + IN_INTERVAL, max(k, done + 1))
        while end < d and value(end) - value(end + 1) < LEAST_GAP * largest:
            end += 1
        lower = (value(end) + value(end + 1)) / 2 if end < d else low
        found.append(_interval(v, lower, upper, end - done, rng))
        done, upper = end, lower
    if not found:
        return none
    q = np.linalg.qr(np.concatenate([s.vectors[:, np.argsort(-s.values)] for s in found], axis=1))[0]
    values, small = np.linalg.eigh((q.T @ v @ q + (q.T @ v @ q).T) / 2)
    values, q = values[::-1][:k], (q @ small)[:, ::-1][:, :k]
    return Spectrum(values, q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(k)]))


def whole_numbers(vector: Column) -> Column:
    """floor(256 * entry) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite and, as 256ths, fit into a long."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * SCALE < float(_LONG)))


def _padded(x: Column, width: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch, width)
            small = x.size == 0 or float(np.abs(x.astype(np.float64)).max()) * len(x) < 2**62
            n += len(x)
            total = total + (x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0))
        values = [Decimal(n), *[Decimal(int(t)) for t in total]]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["dim", "part"])

    found = fit.mapInArrow(work, "dim int, part decimal(38,0)").groupBy("dim").agg(F.sum("part").alias("s")).collect()
    by_dim = {r.dim: int(r.s) for r in found}
    return by_dim.get(-1, 0), [by_dim.get(k, 0) for k in range(width)]


def _products(fit: DataFrame, width: int, project: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of the outer products of project(vector) with itself over all vectors; each task sums its own first."""
    i, j = np.triu_indices(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = project(_matrix(batch, width))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "part"])

    found = fit.mapInArrow(work, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("s")).toArrow()
    out = np.zeros((size, size))
    rows, cols = found["i"].to_numpy(), found["j"].to_numpy()
    out[rows, cols] = out[cols, rows] = found["s"].to_numpy()
    return out


def whiten(vectors: DataFrame, *, vector_col: str = "embedding", components: int = 4, carry: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """One row per usable row: the columns of `carry`, n, deviation, whitened (array of double, a value for each component), explained (likewise), identity_error.

    Entries c become whole numbers x = floor(256 * c). The model is fitted to each distinct x vector once: n vectors
    with sums S per dimension, covariance with divisor n, centred before multiplying. whitened is x - S/n projected on
    the `components` leading eigenvectors, over the square root of the eigenvalue; explained is the eigenvalue over
    the trace; deviation the exact sum of (n * x - S)^2 (null beyond a long); identity_error the largest entry of the
    whitened fit list's measured covariance minus the identity.

    Rows whose vector is null, or has a null, NaN, infinite or out of range entry, are left out; so are other columns
    (a carried one of an output's name gets `_in`). Repeated rows each get a result. Vectors shorter than the longest
    count as if zeros stood at their end; more than MOST_WIDTH entries are an error. Dimensions without variance have
    no component, so fewer than `components` values may come out, and none where all vectors are equal; equal
    eigenvalues share a space of which any basis may come out, the same for all rows. No rows: an empty result.

    What stands in the driver is the covariance, the square of the width. Only the distinct vectors are shuffled, once.
    """
    names = ("n", "deviation", "whitened", "explained", "identity_error")
    through = carried(carry, names)
    stash = Stash(vectors.sparkSession)
    rows = vectors.select(*[F.col(c).alias(k) for k, (c, _) in through.items()], F.col(vector_col).alias("_v")).where(usable(F.col("_v")))
    rows = rows.select(*through, whole_numbers(F.col("_v")).alias("x"))
    fit = stash.keep(rows.select("x").distinct())
    sizes = fit.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
    width = sizes.hi or 0
    if width > MOST_WIDTH:
        raise ValueError(f"vectors of {width} entries: at most {MOST_WIDTH}")
    if sizes.lo != sizes.hi:
        rows = rows.withColumn("x", _padded(F.col("x"), width))
        fit = stash.keep(fit.select(_padded(F.col("x"), width).alias("x")).distinct())
    n, sums = _sums(fit, width)
    mean = np.array([s / n for s in sums]) if n else np.zeros(width)
    v = _products(fit, width, lambda x: x - mean, width) / max(n, 1)
    found = feast(v, components)
    onto = found.vectors / np.sqrt(found.values)
    k = len(found.values)
    unlike = float(np.abs(_products(fit, width, lambda x: (x - mean) @ onto, k) / n - np.eye(k)).max()) if k else 0.0
    stash.only()
    exact = np.array(sums, object)
    reach = max((abs(s) for s in sums), default=0)
    small = np.array(sums, np.int64) if reach < _LONG else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            most = float(np.abs(x.astype(np.float64)).max()) * n + reach if x.size else 0.0
            if small is not None and most * most * max(width, 1) < 2**62:
                deviation = ((n * x - small) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d < _LONG else None for d in ((n * x.astype(object) - exact) ** 2).sum(axis=1).tolist()]
            white = (x - mean) @ onto
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in through], pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(at, pa.array(white.ravel()))], names=[*[name for _, name in through.values()], "deviation", "whitened"])

    fields = [T.StructField(name, vectors.schema[c].dataType) for c, name in through.values()]
    schema = T.StructType([*fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    out = rows.mapInArrow(work, schema)
    trace = float(np.trace(v))
    explained = F.array(*[F.lit(float(e) / trace) for e in found.values]).cast("array<double>")
    own = [F.col("`" + name.replace("`", "``") + "`") for _, name in through.values()]
    return out.select(*own, F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(unlike).alias("identity_error"))
