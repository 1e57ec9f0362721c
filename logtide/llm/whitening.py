"""Whitening of vectors by the leading principal components.

Components are whole numbers, floor(scale * c) + offset, so that sums are exact.
Spark sums them, then the products of the vectors centred at their mean (whole
part and rest taken off one after the other, before anything is multiplied), a
row of the covariance at a time: a task adds up its own d x d part, and parts meet
by row, so that no task gets more than its rows of them.  The driver holds one d x d
matrix, whatever the number of vectors: Householder reflections make it tridiagonal,
bisection on Sturm counts finds the leading eigenvalues, inverse iteration their
vectors, and vectors of close eigenvalues are orthogonalised against each other in every step.
The projection, d x k numbers, is broadcast.  What the projection leaves is measured: the
covariance of the whitened vectors themselves is summed the same way.

Defined results: rows whose vector is null, empty, or holds a null, a non-finite entry
or one whose whole number exceeds 2^40, take no part; of the lengths that occur, the most
frequent takes part (ties: the shorter); rows without id and repeated rows count and come
back like all others; directions without variance (to double precision) are no components,
so there may be fewer than asked, and none for one vector or equal ones; an empty table gives an
empty result; a deviation beyond 64 bits is null; columns kept from the input that are named
like one of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.scratch import written

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
LARGEST = 1 << 40
#: Entries of vectors that are worked on at a time in a task.
ENTRIES = 1 << 20
X = "__x"
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")
EPS = np.finfo(float).eps


# The matrix on the driver ------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections): Householder's similarity of a symmetric matrix."""
    a, reflections = matrix.astype(float).copy(), []
    n = len(a)
    off = np.zeros(max(0, n - 1))
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.sqrt(v @ v)
        if not np.any(v[1:]):
            off[k] = v[0]
            reflections.append(np.zeros(n - k - 1))
            continue
        off[k] = -size if v[0] > 0 else size
        v[0] -= off[k]
        v /= np.sqrt(v @ v)
        below = a[k + 1 :, k + 1 :]
        p = 2 * (below @ v)
        w = p - (v @ p) * v
        below -= np.outer(v, w) + np.outer(w, v)
        reflections.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off, reflections


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are below each number."""
    least = max(EPS * EPS * np.max(off * off, initial=0.0), np.finfo(float).tiny)
    q = diagonal[0] - at
    found = (q < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[i] - at - off[i - 1] ** 2 / q
        found += q < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until the bounds are neighbours."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    norm = max(np.max(np.abs(diagonal) + reach), np.finfo(float).tiny)
    wanted = n - np.arange(k)  # so many eigenvalues are below what is above the j-th largest
    low, high = np.full(k, -norm * (1 + 4 * EPS)), np.full(k, norm * (1 + 4 * EPS))
    for _ in range(200):
        middle = (low + high) / 2
        above = below(diagonal, off, middle) >= wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)
        if np.all(high - low <= EPS * np.maximum(np.abs(low), np.abs(high)) + EPS * EPS * norm):
            break
    return (low + high) / 2


def _factors(diagonal: np.ndarray, off: np.ndarray, at: float, least: float):
    """LU of the tridiagonal matrix minus `at`, rows exchanged where the pivot is the smaller."""
    n = len(diagonal)
    d, u, uu, steps = diagonal - at, np.append(off, 0.0), np.zeros(n), []
    for i in range(n - 1):
        if abs(d[i]) >= abs(off[i]):
            if abs(d[i]) < least:
                d[i] = least
            m = off[i] / d[i]
            d[i + 1] -= m * u[i]
            steps.append((False, m))
        else:
            m = d[i] / off[i]
            d[i], u[i], d[i + 1], uu[i] = off[i], d[i + 1], u[i] - m * d[i + 1], u[i + 1]
            u[i + 1] = -m * u[i + 1]
            steps.append((True, m))
    if abs(d[n - 1]) < least:
        d[n - 1] = least
    return d, u, uu, steps


def _solved(factors, b: np.ndarray) -> np.ndarray:
    d, u, uu, steps = factors
    x, n = b.copy(), len(b)
    for i, (exchanged, m) in enumerate(steps):
        if exchanged:
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
        else:
            x[i + 1] -= m * x[i]
    x[n - 1] /= d[n - 1]
    for i in range(n - 2, -1, -1):
        x[i] = (x[i] - u[i] * x[i + 1] - (uu[i] * x[i + 2] if i + 2 < n else 0.0)) / d[i]
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues, by inverse iteration.

    Eigenvalues closer than a thousandth of the norm form a cluster: each of its vectors is
    orthogonalised against the earlier ones in every step."""
    n, rng = len(diagonal), np.random.default_rng(5)
    norm = max(np.max(np.abs(diagonal)) + 2 * np.max(np.abs(off), initial=0.0), np.finfo(float).tiny)
    out, first, last = np.zeros((n, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        at = min(value, last - 10 * EPS * norm) if j > first else value  # equal ones are parted
        last = at
        factors = _factors(diagonal, off, at, EPS * norm)
        x = rng.standard_normal(n)
        for _ in range(6):
            x = _solved(factors, x / np.max(np.abs(x)))
            x /= np.max(np.abs(x))
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.sqrt(x @ x)
        out[:, j] = x
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns): the k leading ones with variance, falling."""
    n = len(matrix)
    size = np.max(np.abs(matrix), initial=0.0)
    if not size > 0:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, off, reflections = tridiagonal(matrix / size)
    values = leading_values(diagonal, off, min(k, n))
    values = values[values > n * EPS * max(values[0], 0.0)]
    vectors = vectors_of(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    # the quotient of the matrix itself is the more precise value
    values = np.einsum("ij,ij->j", vectors, (matrix / size) @ vectors)
    return values * size, vectors


# The passes over the vectors ------------------------------------------------------------


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(entries, length of each row) of a list column, null as empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def whole_numbers(rows: DataFrame, vector: str, keep: list[str], scale: float, offset: int) -> DataFrame:
    """Kept columns and `__x`, the whole numbers of the vectors that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, sizes = _flat(batch.column(0))
            good = np.isfinite(entries)
            whole = np.floor(np.where(good, entries, 0.0) * scale) + offset
            good &= np.abs(whole) <= LARGEST
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~good)])
            ok = (sizes > 0) & (bad[ends] == bad[ends - sizes])
            kept = np.repeat(ok, sizes)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes[ok])]).astype(np.int32), pa.array(np.where(kept, whole, 0).astype(np.int64)[kept]))
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([*[batch.column(i + 1).take(at) for i in range(len(keep))], lists], names=[*keep, X])

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(X, T.ArrayType(T.LongType()))])
    return rows.select(F.col(f"`{vector}`").cast("array<double>"), *[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def _matrices(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches and their vectors as matrices of a bounded number of entries."""
    step = max(1, ENTRIES // width)
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            if part.num_rows:
                yield part, _flat(part.column(at))[0].reshape(part.num_rows, width)


def _sums(x: DataFrame, width: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of every dimension)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, m in _matrices(batches, 0, width):  # a part has at most 2^20 rows: no overflow
            yield pa.RecordBatch.from_arrays([pa.array([len(m)], pa.int64()), pa.array([m.sum(0)], pa.list_(pa.int64()))], names=["n", "s"])

    parts = x.select(X).mapInArrow(run, "n long, s array<long>").select("n", F.posexplode("s").alias("i", "s"))
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    out = [0] * width
    for r in rows:
        out[r["i"]] = int(r["s"])
    return (rows[0]["n"] if rows else 0), out


def _summed_rows(x: DataFrame, width: int, k: int, part) -> np.ndarray:
    """Sum over all vectors of the k rows that `part` gives for a matrix of them, added up row by row."""
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, m in _matrices(batches, 0, width):
            found = part(m)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = row.values.to_numpy(zero_copy_only=False)
                total[i] = total[i] + row if i in total else row.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "row"])

    schema = "i int, row array<double>"
    rows = x.select(X).mapInArrow(own, schema).repartition("i").mapInArrow(meet, schema).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


@dataclass
class Whitening:
    """What whitens a vector of whole numbers: (x - origin - rest) @ projection."""

    n: int
    width: int
    origin: np.ndarray  # whole part of the mean
    rest: np.ndarray  # what the mean has beyond it
    excess: list[int]  # the same n times, exact
    values: np.ndarray
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors `__x` of a written table; None without vectors."""
    widths = x.groupBy(F.size(X).alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return None
    width = widths[0]["w"]
    x = x.where(F.size(X) == width)
    n, sums = _sums(x, width)
    whole = [(2 * s + n) // (2 * n) for s in sums]
    excess = [s - n * w for s, w in zip(sums, whole)]
    origin, rest = np.array(whole, dtype=np.int64), np.array([e / n for e in excess])

    def product(m: np.ndarray) -> np.ndarray:
        z = (m - origin) - rest
        return z.T @ z

    covariance = _summed_rows(x, width, width, product) / n
    values, vectors = leading((covariance + covariance.T) / 2, components)
    projection, k = vectors / np.sqrt(values), len(values)
    error = 0.0
    if k:
        mean = _summed_rows(x, width, 1, lambda m: (((m - origin) - rest) @ projection).sum(0, keepdims=True))[0] / n

        def left(m: np.ndarray) -> np.ndarray:
            w = ((m - origin) - rest) @ projection - mean
            return w.T @ w

        error = float(np.max(np.abs(_summed_rows(x, width, k, left) / n - np.eye(k))))
    return Whitening(n, width, origin, rest, excess, values, projection, values / np.trace(covariance) if k else values, error)


def apply(x: DataFrame, model: Whitening, keep: list[str]) -> DataFrame:
    """A row for each vector and component, with the kept columns."""
    width, k = model.width, len(model.values)
    shared = x.sparkSession.sparkContext.broadcast((model.origin, model.rest, np.array([e % (1 << 64) for e in model.excess], dtype=np.uint64), model.projection, model.explained))
    n, error = model.n, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, rest, excess, projection, explained = shared.value
        for batch, m in _matrices(batches, len(keep), width):
            y = m - origin
            z = y - rest
            white = z @ projection
            about = ((z * n) ** 2).sum(1)
            # exact modulo 2^64, so exact where the sum is below 2^63
            d = y.astype(np.uint64) * np.uint64(n) - excess
            exact = (d * d).sum(1, dtype=np.uint64)
            fits = (about < 2.0**62.9) & (exact < np.uint64(1 << 63))
            deviation = pa.array(exact.view(np.int64), pa.int64(), mask=~fits)
            rows, at = len(m), pa.array(np.repeat(np.arange(len(m)), k))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(at) for i in range(len(keep))], pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()),
                 deviation.take(at), pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                names=[*keep, *RESULT])

    kinds = (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([x.schema[c] for c in keep] + [T.StructField(c, t) for c, t in zip(RESULT, kinds)])
    rows = x.where(F.size(X) == width).select(*[f"`{c}`" for c in keep], X) if k else x.limit(0).select(*[f"`{c}`" for c in keep], X)
    return rows.mapInArrow(run, schema)


def whiten(rows: DataFrame, keep: list[str], vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """The kept columns of `rows` with component, n, deviation, whitened, explained and identity_error, by their own covariance."""
    keep = [c for c in keep if c not in (*RESULT, X)]
    x = written(whole_numbers(rows, vector, keep, scale, offset), "whole-numbers")
    model = fit(x, components) or Whitening(0, 1, np.zeros(1, np.int64), np.zeros(1), [0], np.zeros(0), np.zeros((1, 0)), np.zeros(0), 0.0)
    return apply(x, model, keep)
