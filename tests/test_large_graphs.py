"""What is done beyond one task's size equals what is done within it."""

import random

import numpy as np

from pyspark.sql import functions as F

from tracklane.operators import graphs, spectral, tiles


def test_betweenness_by_slices_of_components_equals_levels(spark):
    r = random.Random(4)
    e = spark.createDataFrame(sorted({(r.randrange(14), r.randrange(14)) for _ in range(30)} | {(20, 21), (21, 22)}), "u bigint, v bigint")
    n = spark.createDataFrame([(i,) for i in range(23)] + [(21,)], "node bigint")
    got = [{x.node: round(x.score, 9) for x in graphs.betweenness(e, n, few=few).collect()} for few in (10_000, 3)]
    assert got[0] == got[1] and len(got[0]) > 10


def test_regions_of_correlations_that_are_not_stored(spark):
    g = np.random.default_rng(0)
    base = g.normal(size=(3, 40))
    x = np.array([base[i % 3] + 0.3 * g.normal(size=40) for i in range(60)])
    d = spark.createDataFrame([(i, t, float(x[i, t])) for i in range(60) for t in range(40)], "node bigint, t int, v double")
    far, near = ({r.node: r.region for r in spectral.correlated_regions(d, "node", "t", "v", 3, most=most).collect()} for most in (10, 4096))
    assert far == near == {i: i % 3 for i in range(60)}


def test_laplacian_vectors_of_many_components(spark):
    """Eight rings: eigenvalue zero eight times, which the block iteration did not tell apart."""
    e = spark.createDataFrame([(k * 10 + i, k * 10 + (i + 1) % 10) for k in range(8) for i in range(10)], "u bigint, v bigint")
    got = {r.node: np.array(r.place) for r in spectral.laplacian_vectors(e, 3, most=20).collect()}
    v = np.array([got[i] for i in range(80)])
    assert np.allclose(v.T @ v, np.eye(3)) and all(np.allclose(got[k * 10 + i], got[k * 10]) for k in range(8) for i in range(10))


def test_products_of_classes_of_equal_series_are_those_of_nodes(spark):
    """Each product worked out the correlations of all nodes, however many had the same series."""
    g = np.random.default_rng(3)
    base = g.normal(size=(3, 20))
    x = np.array([base[i % 3] + 0.3 * g.normal(size=20) for i in range(21)])
    x[20] = 4.0  # a constant, whose copies don't correlate with each other
    x = np.vstack([x, x[:15], x[18:], x[:6]])
    d = spark.createDataFrame([(i, t, float(x[i, t])) for i in range(45) for t in range(20) if (i + t) % 7], "node bigint, t int, v double")
    d = d.unionAll(d.where("node < 9").selectExpr("node + 100", "t", "v"))
    rows = tiles.stored(d, "node", "t", "v")
    classes = tiles.alike(rows)
    of = rows.join(classes.select("t", "v", F.col("node").alias("class")), ["t", "v"]).select("node", "class", tiles.with_itself("v").alias("own"))
    w = rows.select("node", F.array((F.col("node") % 5).cast("double"), F.lit(1.0)).alias("x"))
    want, got = ({r.u: r.s for r in s.collect()} for s in (spectral._strengths(rows, w, 2), spectral._shared_strengths(classes, of, w, 2)))
    assert classes.count() < rows.count() == len(want) and want.keys() == got.keys() and all(np.allclose(want[k], got[k]) for k in want)
    far, near = ({r.node: r.region for r in spectral.correlated_regions(d.where("node not in (20, 38)"), "node", "t", "v", 3, most=most).collect()} for most in (10, 4096))
    assert far == near and len(set(far.values())) == 3
