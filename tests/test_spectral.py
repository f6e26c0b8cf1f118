"""Eigenvectors of tables against dense ones."""

import numpy as np
import pytest

from tracklane.operators import matrices, spectral


def test_lowest_vectors_are_those_of_the_dense_matrix(spark):
    """A weighted graph of two parts that hardly touch: values, residuals and the spans of vectors."""
    r = np.random.default_rng(2)
    n = 60
    a = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            if r.random() < (0.3 if i // 30 == j // 30 else 0.004):
                a[i, j] = a[j, i] = r.uniform(0.5, 2)
    for i in range(n - 1):
        a[i, i + 1] = a[i + 1, i] = 1.0
    d = spark.createDataFrame([(i, float(a[i].sum())) for i in range(n)], "node bigint, d double")
    links = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "u bigint, v bigint, weight double")
    got, values = spectral.lowest(d, links, 3)
    x = np.array([v.vector for v in got.orderBy("node").collect()])
    m = np.diag(a.sum(1)) - a
    want, vectors = np.linalg.eigh(m)
    assert values == pytest.approx(want[:3], abs=1e-8) and np.linalg.norm(m @ x - x * values, axis=0).max() < 1e-5
    assert np.abs(x.T @ x - np.eye(3)).max() < 1e-6 and np.linalg.svd(vectors[:, :3].T @ x)[1].min() > 1 - 1e-6


def test_vectors_beyond_the_dense_limit(spark):
    """A path of forty nodes: its vectors are cosines."""
    e = spark.createDataFrame([(i, i + 1) for i in range(39)], "u bigint, v bigint")
    dense = {r.node: r.place for r in spectral.laplacian_vectors(e, 3).collect()}
    tables = {r.node: r.place for r in spectral.laplacian_vectors(e, 3, most=10).collect()}
    assert set(tables) == set(range(40))
    for k in range(3):
        wave = np.cos(np.pi * k * (np.arange(40) + 0.5) / 40)
        wave *= np.sign(wave[0]) / np.linalg.norm(wave)
        for got in (dense, tables):
            assert np.array([got[i][k] for i in range(40)]) == pytest.approx(wave, abs=1e-5)


def test_regions_of_tables_are_those_of_a_matrix(spark):
    r = np.random.default_rng(5)
    n = 45
    c = np.where(np.arange(n)[:, None] // 15 == np.arange(n) // 15, 0.8, 0.05) + 0.02 * r.standard_normal((n, n))
    c = (c + c.T) / 2
    pairs = spark.createDataFrame([(i, j, float(-c[i, j] if (i + j) % 3 else c[i, j])) for i in range(n) for j in range(i + 1, n)], "i bigint, j bigint, corr double")
    got = [x.region for x in spectral.regions(pairs, 3).orderBy("node").collect()]
    assert got == list(matrices.regions(c, 3)) == [i // 15 for i in range(n)]
