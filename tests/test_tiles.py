"""All pairs by tiles against all pairs at once: bands, gaps, ties, constants, quantiles by narrowing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.operators import series, tiles


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((23, 12))
    x[3], x[4], x[7] = 2.0, x[5], -x[5]  # a constant and copies
    rows = [(int(i) * 7, int(t), float(x[i, t])) for i in range(23) for t in range(12) if r.random() < 0.8]
    return spark.createDataFrame(rows, "node bigint, t int, v double").cache()


def brute(panel):
    p = series.pairs(panel, "node", "t", "v").groupBy("i", "j").agg(series.guarded_corr(F.col("x"), F.col("y")).alias("corr"), F.count("*").alias("n"))
    return {(r.i, r.j): (r["corr"], r.n) for r in p.collect()}


@pytest.mark.parametrize("widest", [1 << 22, 40])
def test_tiles_hold_each_pair_once_in_any_number_of_bands(panel, monkeypatch, widest):
    monkeypatch.setattr(tiles, "WIDEST", widest)
    want = brute(panel)
    got = series.block_corr(panel, "node", "t", "v", 4).collect()
    assert len(got) == len(want) and all(abs(r["corr"] - want[r.i, r.j][0]) < 1e-9 and r.n == want[r.i, r.j][1] for r in got)
    assert series.block_corr(panel.withColumn("t", F.concat(F.lit("t"), "t")), "node", "t", "v", 4).count() == len(want)
    assert series.block_corr(panel.where("false"), "node", "t", "v").count() == 0


def test_sums_quantiles_and_largest_are_those_of_all_pairs(panel):
    rows, want = tiles.stored(panel, "node", "t", "v"), brute(panel)
    gap = lambda t: np.abs(t.a[:, None] - t.b[None, :]) // 50
    parts = {}
    for (i, j), (r, _) in want.items():
        parts.setdefault(abs(i - j) // 50, []).append(r)
    got = {r.part: r for r in tiles.totals(rows, gap, extremes=True).collect()}
    assert got.keys() == parts.keys()
    for g, x in parts.items():
        assert got[g].n == len(x) and np.allclose([got[g].s, got[g]["size"], got[g].square, got[g].low, got[g].high], [sum(x), np.abs(x).sum(), np.square(x).sum(), min(x), max(x)])
    for few in (1 << 17, 2):  # listed at once, or narrowed again and again
        q, sums = tiles.quantiles(rows, [0.05, 0.5, 0.95], gap, absolute=True, parts=8, few=few)
        assert all(np.allclose(q[g], np.quantile(np.abs(x), [0.05, 0.5, 0.95])) and sums[g][0] == len(x) for g, x in parts.items())
    top = tiles.over_pairs(rows, tiles.largest(9, 0.1), "i long, j long, corr double", 4).collect()
    best = sorted((-round(abs(r), 9), i, j) for (i, j), (r, _) in want.items())[:9]
    assert {(r.i, r.j) for r in top} >= {(i, j) for _, i, j in best if abs(_) < 1}


def test_pairs_are_not_shuffled(spark, panel):
    """A value goes once to each band; before, once to each block of 256 nodes, and queries stored or sorted all pairs."""
    rows = tiles.stored(panel, "node", "t", "v")
    for plan in (tiles.over_pairs(rows, tiles.listed, "i long, j long, corr double, n long", 1), tiles.over_pairs(rows, tiles.largest(9, 0.1), "i long, j long, corr double", 1)):
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert tiles.BANDS * (tiles.BANDS + 1) // 2 == tiles.over_pairs(rows, tiles.listed, "i long, j long, corr double, n long", 1).rdd.getNumPartitions()


@pytest.mark.parametrize("widest", [1 << 22, 40])
def test_classes_of_equal_series_stand_for_all_their_nodes(panel, monkeypatch, widest):
    """Each node's pairs were worked out, however many nodes have the same series."""
    monkeypatch.setattr(tiles, "WIDEST", widest)
    copies = panel.unionAll(panel.selectExpr("node + 1000", "t", "v")).unionAll(panel.where("node < 70").selectExpr("node + 2000", "t", "v"))
    rows = tiles.stored(copies, "node", "t", "v")
    few = tiles.alike(rows)
    assert rows.count() == 56 and few.count() == 23 and {r.w for r in few.collect()} == {2, 3}
    half = lambda t: (t.r > 0.3).astype(np.int64)
    (a, b) = ({r.part: r for r in tiles.totals(d, half, extremes=True).collect()} for d in (rows, few))
    assert a.keys() == b.keys() and all(np.allclose([*a[k]], [*b[k]]) for k in a)
    for few_values in (1 << 17, 2):
        (q, s), (p, z) = (tiles.quantiles(d, [0.05, 0.5, 0.95], parts=8, few=few_values) for d in (rows, few))
        assert np.allclose(q[0], p[0]) and np.allclose(s[0], z[0])


def test_means_are_the_same_in_any_order(spark):
    """Copies of a node had means of other last bits, and so other series."""
    r = np.random.default_rng(8)
    x = [0.1, 0.2, 0.3, 560.21, -7e5, 1 / 3, 0.0]
    rows = [(g, float(v)) for g in range(40) for v in r.permutation(x)] + [(100, 1e-30), (100, 3e-30), (101, None), (102, 3e9), (102, None), (103, float("nan"))]
    d = spark.createDataFrame(rows, "g int, v double").repartition(7)
    got = {q.g: q.m for q in d.groupBy("g").agg(series.steady_mean("v").alias("m")).collect()}
    assert len({got[g] for g in range(40)}) == 1 and abs(got[0] - sum(x) / 7) < 1e-9
    assert got[100] == 2e-30 and got[101] is None and got[102] == 3e9 and np.isnan(got[103])


@pytest.mark.parametrize("widest", [1 << 22, 40])
def test_pairs_named_apart_are_parts_of_classes(panel, monkeypatch, widest):
    """Parts of pairs of nodes, told by the nodes, are counted in pairs of classes."""
    monkeypatch.setattr(tiles, "WIDEST", widest)
    copies = panel.selectExpr("node * 3 AS node", "t", "v").unionAll(panel.selectExpr("node * 3 + 2", "t", "v")).unionAll(panel.where("node < 70").selectExpr("node * 3 + 1000", "t", "v"))
    rows = tiles.stored(copies, "node", "t", "v")
    classes = tiles.alike(rows)
    of = tiles.members(rows, classes)
    nodes = sorted(r.node for r in of.collect())
    gap = lambda t: np.where(np.abs(t.a[:, None] - t.b[None, :]) <= 2, 0, np.where(np.abs(t.a[:, None] - t.b[None, :]) <= 21, 1, 2))
    near = [(i, j, 0 if j - i <= 2 else 1) for i in nodes for j in nodes if 0 < j - i <= 21]
    named = tiles.apart(classes, of, rows.sparkSession.createDataFrame(near, "i long, j long, part int"))
    for few in (1 << 17, 2):
        (q, s), (p, z) = tiles.quantiles(rows, [0.1, 0.95], gap, True, 8, few), tiles.quantiles(named, [0.1, 0.95], None, True, 8, few, 2)
        assert q.keys() == p.keys() == {0, 1, 2} and all(np.allclose(q[g], p[g]) and np.allclose(s[g], z[g]) for g in q)
