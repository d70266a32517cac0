"""Whitening against numpy's own eigenvectors and sums in Python integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import whitening
from tapeline.llm.catalog import QUERIES

SHAPE = "vec_id long, embedding array<float>, label int"


def checked(rows, vectors):
    """``rows`` of whiten() hold for ``vectors`` (id -> list of floats)."""
    x = np.array([[math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v] for v in vectors.values()], object)
    n, sums = len(x), x.sum(0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes.T[::-1]
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == set(vectors)
    k = max(r.component for r in rows)
    got = np.array([[by_id[i][c].whitened for c in range(1, k + 1)] for i in vectors])
    for c in range(k):
        want = centred @ axes[c] / np.sqrt(values[c])
        assert min(np.abs(got[:, c] - want).max(), np.abs(got[:, c] + want).max()) < 1e-7
    for i, row in zip(vectors, x):
        first = by_id[i][1]
        assert first.n == n and first.deviation == sum((n * a - s) ** 2 for a, s in zip(row, sums))
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 for r in rows)
    error = np.abs(got.T @ got / n - np.eye(k)).max()
    assert all(abs(r.identity_error - error) < 1e-9 and r.identity_error < 1e-4 for r in rows)
    return k


def test_given_vectors(spark):
    rows = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001").collect()
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    assert checked(rows, {r.vec_id: r.embedding for r in given}) == 32


@pytest.mark.parametrize("d", [1, 2, 3, 7, 60])
def test_eigen_of_hard_matrices(d):
    rng = np.random.default_rng(d)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for spectrum in (np.arange(1.0, d + 1), np.ones(d), np.where(np.arange(d) < d // 2, 5.0, 2.0), 10.0 ** -np.arange(d), np.where(np.arange(d) % 2 > 0, 1.0, 1 + 1e-9)):
        m = basis @ np.diag(spectrum) @ basis.T
        m = (m + m.T) / 2
        values, vectors = whitening.eigen(m, 32)
        want = np.sort(spectrum)[::-1][: len(values)]
        assert len(values) >= min(32, d, int((spectrum > 1e-11 * spectrum.max()).sum())) and np.allclose(values, want, rtol=1e-9, atol=1e-13 * spectrum.max())
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-10
        assert np.abs(m @ vectors.T - vectors.T * values).max() < 1e-11 * spectrum.max()
    assert len(whitening.eigen(np.zeros((d, d)))[0]) == 0


def test_sturm_counts():
    rng = np.random.default_rng(3)
    diagonal, sub = rng.standard_normal(20), rng.standard_normal(19)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(sub, 1) + np.diag(sub, -1))
    marks = np.linspace(-4, 4, 33)
    assert (whitening.below(diagonal, sub, marks) == [(values < m).sum() for m in marks]).all()


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    good = {i: rng.standard_normal(4).tolist() for i in range(50)}
    good[50] = good[51] = good[0]
    bad = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [1.0, float("nan"), 2.0, 3.0], 1), (103, [1.0, float("inf"), 2.0, 3.0], None), (104, [], 1), (105, [1.0, 2.0], 1)]
    rows = [(i, v, None) for i, v in good.items()] + bad
    df = spark.createDataFrame(rows, SHAPE).repartition(5).withColumn("component", F.lit("clash")).withColumn("i", F.lit(7)).withColumn("row", F.lit("r"))
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "label", "i", "row", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert checked(got.collect(), good) == 4
    twice = spark.createDataFrame([(None, v, 0) for v in list(good.values())[:50]] + [(1, good[0], 0)], SHAPE)
    assert whitening.whiten(twice).filter("vec_id IS NULL").count() == 200
    for empty in ([], bad[:5], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(9)]):
        assert whitening.whiten(spark.createDataFrame(empty, SHAPE)).count() == 0
    flat = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 5)], 0) for i in range(20)], SHAPE)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_large_entries(spark):
    """Sums of entries beyond 32 bits stay exact; a deviation beyond 64 bits is null, scaled entries stop at 2**52, and a dimension
    that is small beside them is rounding noise."""
    doubles = "vec_id long, embedding array<double>"
    rows = spark.createDataFrame([(0, [1e30, 1.0]), (1, [2.0**40, 2.0]), (2, [-(2.0**40), 5.0])], doubles)
    got = whitening.whiten(rows).collect()
    assert len(got) == 3 and all(r.deviation is None for r in got) and all(math.isfinite(r.whitened) for r in got)
    mild = spark.createDataFrame([(0, [2.0**18, 1.0]), (1, [2.0**18 + 1, 3.0]), (2, [2.0**18, 7.0])], doubles)
    x = [[int(math.floor(c * 64)) + 1_000_000 for c in r.embedding] for r in mild.orderBy("vec_id").collect()]
    sums = [sum(c) for c in zip(*x)]
    assert {r.vec_id: r.deviation for r in whitening.whiten(mild).collect()} == {i: sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in enumerate(x)}
