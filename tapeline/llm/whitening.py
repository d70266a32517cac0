"""Whitening of embedding vectors by the leading eigenvectors of their covariance.

Three passes over the vectors, none of which shuffles them. The first adds up count and sums, in whole numbers. The second adds
up products of centred entries: every task makes one matrix, whose rows are dealt by row number and added there. The driver gets
one matrix of dimension x dimension, whatever the number of vectors, and takes it apart: Householder reflections make it
tridiagonal, bisection on Sturm counts finds the leading eigenvalues, inverse iteration their vectors, made orthogonal inside
clusters of close eigenvalues. The last two passes project on the components, which are broadcast (32 x dimension numbers): one
measures the covariance of the result, the other returns it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import batches, rows_of

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
LARGEST = 1 << 52  # scaled entries beyond it count as it
ROUNDING = 1e-12  # eigenvalues below this part of the largest are rounding noise
BATCH = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors without null or non-finite entries; where lengths differ, those of the most frequent length (the longer of equals)."""
    c = F.col("embedding")
    known = vectors.filter(c.isNotNull() & (F.size(c) > 0))
    known = known.filter(F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
    lengths = known.groupBy(F.size(c).alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return known.filter(F.size(c) == lengths[0]["length"]) if lengths else known.limit(0)


def whole_numbers(batch: pa.RecordBatch) -> np.ndarray:
    """floor(64 c) + 1,000,000 of every entry, one row per vector."""
    column = batch.column("embedding")
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.clip(np.floor(entries * SCALE), -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT
    return scaled.reshape(len(column), -1)


@dataclass(frozen=True)
class Moments:
    """Number of vectors and exact sums per dimension."""

    n: int
    sums: tuple[int, ...]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part is taken off in whole numbers, so nothing cancels."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(np.float64) - np.array([(s % self.n) / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) squared, exact; null where it does not fit 64 bits."""
        low, high = x.min(0).tolist(), x.max(0).tolist()
        far = max(max(abs(self.n * a - s), abs(self.n * b - s)) for a, b, s in zip(low, high, self.sums))
        if max(map(abs, self.sums)) < 1 << 62 and far < 1 << 31 and far * far * x.shape[1] < 1 << 63:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def moments(vectors: DataFrame) -> Moments | None:
    """Count and sums, added in two halves of 32 bits so that no partial sum overflows."""

    def add(source):
        n, high, low = 0, 0, 0
        for batch in batches(source, BATCH):
            x = whole_numbers(batch)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield rows_of(shape, [range(len(high)), [n] * len(high), high, low])

    shape = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
    parts = vectors.select("embedding").mapInArrow(add, "i int, n long, high long, low long")
    rows = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()  # one per dimension
    return Moments(rows[0]["n"], tuple((r["high"] << 32) + r["low"] for r in rows)) if rows else None


def _products(vectors: DataFrame, rows_in) -> np.ndarray:
    """Sum of the outer products of ``rows_in(batch)``, as one matrix."""

    def multiply(source):
        total = None
        for batch in batches(source, BATCH):
            x = rows_in(batch)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield rows_of(shape, [range(len(total)), list(total)])

    def add(source):
        totals: dict[int, np.ndarray] = {}
        for batch in source:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist()):
                totals[i] = totals[i] + np.array(row) if i in totals else np.array(row)
        yield rows_of(shape, [list(totals), list(totals.values())])

    shape = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])
    ddl = "i int, row array<double>"
    parts = vectors.select("embedding").mapInArrow(multiply, ddl).repartition("i").mapInArrow(add, ddl)
    rows = sorted((r["i"], r["row"]) for r in parts.collect())  # dimension x dimension numbers
    return np.array([row for _, row in rows])


def covariance(vectors: DataFrame, at: Moments) -> np.ndarray:
    total = _products(vectors, lambda batch: at.centred(whole_numbers(batch)))
    return (total + total.T) / (2 * at.n)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and the unit reflectors that lead to them, column by column."""
    a, d = matrix.copy(), len(matrix)
    reflectors = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.sqrt(v @ v)
        if size == 0 or not v[1:].any():
            reflectors.append(np.zeros_like(v))
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.sqrt(v @ v)
        reflectors.append(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflectors


def below(diagonal: np.ndarray, sub: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are smaller than each of ``marks``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, q = np.zeros(len(marks), int), np.ones(len(marks))
    with np.errstate(over="ignore"):  # a quotient by a tiny pivot may be infinite; its sign counts
        for i, x in enumerate(diagonal):
            q = x - marks - (sub[i - 1] ** 2 / q if i else 0)
            q = np.where(np.abs(q) < tiny, -tiny, q)
            count += q < 0
    return count


def leading_values(diagonal: np.ndarray, sub: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection of all of them side by side."""
    d = len(diagonal)
    around = np.zeros(d)
    around[1:] += np.abs(sub)
    around[:-1] += np.abs(sub)
    low, high = np.full(most, (diagonal - around).min()), np.full(most, (diagonal + around).max())
    pad = np.finfo(float).eps * max(np.abs(low).max(), np.abs(high).max(), np.finfo(float).tiny) * d
    low, high = low - pad, high + pad
    wanted = d - 1 - np.arange(most)  # so many eigenvalues lie below the one sought
    while True:
        middle = (low + high) / 2
        open_ = (low < middle) & (middle < high) & (high - low > pad / d / 4)
        if not open_.any():
            return middle
        under = below(diagonal, sub, middle) <= wanted
        low, high = np.where(open_ & under, middle, low), np.where(open_ & ~under, middle, high)


def _solve(diagonal: np.ndarray, sub: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - value) y = right by elimination with row exchanges; a zero pivot counts as ``least``."""
    d = len(diagonal)
    a, b, c = diagonal - value, np.append(sub, 0.0), np.zeros(d)  # pivots and the two diagonals above
    y = right.copy()
    for i in range(d - 1):
        if abs(sub[i]) > abs(a[i]):  # the next row comes first
            a[i], b[i], c[i], under, after = sub[i], a[i + 1], b[i + 1], a[i], b[i]
            y[i], y[i + 1] = y[i + 1], y[i]
            ratio = under / a[i]
            a[i + 1], b[i + 1] = after - ratio * b[i], -ratio * c[i]
        else:
            a[i] = a[i] if abs(a[i]) > least else np.copysign(least, a[i])
            ratio = sub[i] / a[i]
            a[i + 1] -= ratio * b[i]
        y[i + 1] -= ratio * y[i]
    a[-1] = a[-1] if abs(a[-1]) > least else np.copysign(least, a[-1])
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            y[i] -= b[i] * y[i + 1]
        if i + 2 < d:
            y[i] -= c[i] * y[i + 2]
        y[i] /= a[i]
        if abs(y[i]) > 1e200:  # only the direction counts
            y /= abs(y[i])
    return y


def eigen(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and their unit vectors as rows; those that are rounding noise are left out."""
    d = len(matrix)
    diagonal, sub, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, sub, min(most, d))
    norm = max(np.abs(diagonal).max() + 2 * np.abs(sub).max(initial=0.0), np.finfo(float).tiny)
    values = values[values > ROUNDING * norm]
    least, rng = np.finfo(float).eps * norm, np.random.default_rng(13)
    found: list[np.ndarray] = []
    start = 0  # of the cluster
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        # equal eigenvalues are told apart by a few roundings, so that the solutions differ
        y = rng.standard_normal(d)
        for _ in range(4):
            y = _solve(diagonal, sub, value - (k - start) * 4 * least, y, least)
            for _ in range(2):
                for other in found[start:k]:
                    y -= (other @ y) * other
            y /= np.sqrt(y @ y)
        found.append(y)
    vectors = np.array(found).reshape(len(values), d)
    for k in range(d - 3, -1, -1):  # back through the reflections
        vectors[:, k + 1 :] -= 2 * np.outer(vectors[:, k + 1 :] @ reflectors[k], reflectors[k])
    return values, vectors


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """The columns of ``vectors`` but embedding, with component, n, deviation, whitened, explained and identity_error; a row for
    every usable vector and component.

    Rows whose embedding is null, empty, of another length than most, or holds a null or non-finite entry are left out. Repeated
    rows count as often as they occur. A null id is an id. Components are at most ``most``, at most the dimension, and only
    those whose variance is not rounding noise: vectors that are all equal, or a single one, give no row. Columns with the names
    of results are replaced.
    """
    added = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    shape = pa.schema(
        [("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
    )
    own = [c for c in vectors.columns if c != "embedding" and c not in shape.names]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.schema if f.name in own)
    fit = usable(vectors.select(*own, "embedding"))
    at = moments(fit)
    if at is None:
        return vectors.sparkSession.createDataFrame([], fields + added)
    v = covariance(fit, at)
    values, components = eigen(v, most)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], fields + added)
    axes = vectors.sparkSession.sparkContext.broadcast(components / np.sqrt(values)[:, None])

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return at.centred(whole_numbers(batch)) @ axes.value.T

    error = float(np.abs(_products(fit, project) / at.n - np.eye(len(values))).max())
    explained = values / np.trace(v)

    def returned(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches(source, BATCH):
            rows, x = batch.num_rows, whole_numbers(batch)
            copies = pa.array(np.repeat(np.arange(rows), k))
            told = [
                np.tile(np.arange(1, k + 1), rows), np.full(rows * k, at.n), pa.array(at.deviations(x), pa.int64()).take(copies),
                (at.centred(x) @ axes.value.T).ravel(), np.tile(explained, rows), np.full(rows * k, error),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(copies) for c in own], *rows_of(shape, told).columns], names=[*own, *shape.names])

    return fit.mapInArrow(returned, fields + added)
