"""Operators on hand-made frames: gaps, constants, ties, single rows."""

import random
from collections import Counter

import pytest

from tracklane.operators import clean, graphs, series


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_interpolation_fills_up_to_three_from_either_side(spark):
    values = [None, 1.0, *[None] * 7, 9.0, None]
    df = frame(spark, [("a", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    got = [r.v for r in clean.interpolate(df, ["k"], ["i"], "v", 3).orderBy("i").collect()]
    assert got[:5] == [1.0, 1.0, 2.0, 3.0, 4.0] and got[6:] == [6.0, 7.0, 8.0, 9.0, 9.0]
    assert got[5] == 5.0  # the median of the group


def test_constant_series_correlate_with_nothing(spark):
    df = frame(spark, [(n, t, 1.0 if n == "a" else float(t)) for n in "ab" for t in range(12)], "node string, t int, v double")
    assert {r["corr"] for r in series.rolling_corr(df, "node", "t", "v").collect()} == {0.0}


def test_ranked_breaks_ties_by_order(spark):
    df = frame(spark, [("a", 1.0, i) for i in range(5)], "g string, x double, i int")
    from pyspark.sql import functions as F

    assert [r.i for r in series.ranked(df, ["g"], [F.desc("x"), "i"], 2).orderBy("rnk").collect()] == [0, 1]


def test_components_of_a_chain(spark):
    df = frame(spark, [(i, i + 1) for i in range(0, 30)] + [(50, 51)], "u bigint, v bigint")
    got = {r.node: r.component for r in graphs.connected(df).collect()}
    assert {got[i] for i in range(31)} == {0} and got[51] == 50


def test_shortest_paths_take_the_cheaper_way(spark):
    e = frame(spark, [(0, 1, 10.0), (0, 2, 1.0), (2, 1, 2.0)], "u bigint, v bigint, length_m double")
    p = frame(spark, [(0, 1)], "source bigint, target bigint")
    r = graphs.shortest_paths(e, p).first()
    assert (r["length"], r["hops"]) == (3.0, 2)


def test_betweenness_of_a_path(spark):
    e = frame(spark, [(0, 1), (1, 2), (2, 3)], "u bigint, v bigint")
    got = {r.node: r.score for r in graphs.betweenness(e, frame(spark, [(i,) for i in range(4)], "node bigint")).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 0.0}


def test_positions_run_over_all_ranges(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("x"), F.lit("s").alias("s"))
    got = [(r.x, r.idx) for r in graphs.indexed(df, ["x"]).collect()]
    assert [x for x, _ in sorted(got, key=lambda g: g[1])] == sorted(x for x, _ in got) and sorted(i for _, i in got) == list(range(5000))
    assert graphs.indexed(df.limit(0), ["x"]).count() == 0


@pytest.mark.parametrize("most_rows", [200_000_000, 60])
def test_betweenness_of_a_random_graph(spark, most_rows):
    """Against all pairs' path counts: a node on shortest paths from s to t has its share of them; also in blocks of sources."""
    r = random.Random(3)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(32)}
    far, ways = {(s, s): 0 for s in range(14)}, Counter({(s, s): 1 for s in range(14)})
    for s in range(14):
        layer = {s}
        for k in range(1, 15):
            new = {v for u, v in edges if u in layer and (s, v) not in far}
            for u, v in edges:
                if u in layer and v in new:
                    ways[s, v] += ways[s, u]
            far.update({(s, v): k for v in new})
            layer = new
    want = {x: sum(ways[s, x] * ways[x, t] / ways[s, t] for s, t in far if x not in (s, t) and (s, x) in far and (x, t) in far and far[s, x] + far[x, t] == far[s, t]) for x in range(14)}
    e = frame(spark, sorted(edges), "u bigint, v bigint")
    got = {x.node: x.score for x in graphs.betweenness(e, frame(spark, [(i,) for i in range(14)], "node bigint"), most_rows).collect()}
    assert all(abs(got.get(x, 0) - want[x]) < 1e-9 for x in want)


def test_sampled_betweenness_of_a_star_is_exact_with_all_sources(spark):
    e = frame(spark, [(0, k) for k in range(1, 6)] + [(3, 0), (2, 2)], "u bigint, v bigint")
    got = {r.node: r.score for r in graphs.sampled_betweenness(e).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert {r.node: r.score for r in graphs.sampled_betweenness(e, 0.1, 2).collect()}.keys() == got.keys()


def test_block_correlations_by_brute_force(spark):
    """Gaps, nulls, a constant and a single value; blocks of three nodes."""
    import numpy as np

    r = np.random.default_rng(1)
    v = {n: {t: 5.0 if n == 3 else float(r.normal()) for t in range(20) if r.random() < 0.7} for n in range(11)}
    v[10] = {4: 1.0}
    df = frame(spark, [(n, t, x) for n, own in v.items() for t, x in own.items()] + [(0, 50, None)], "node bigint, t int, v double")
    got = {(x.i, x.j): (x["corr"], x.n) for x in series.block_corr(df, "node", "t", "v", 3).collect()}
    for a in v:
        for b in v:
            both = sorted(v[a].keys() & v[b].keys())
            if a >= b or not both:
                assert (a, b) not in got
                continue
            x, y = np.array([v[a][t] for t in both]), np.array([v[b][t] for t in both])
            want = 0.0 if x.std() < 1e-12 or y.std() < 1e-12 else np.corrcoef(x, y)[0, 1]
            assert abs(got[a, b][0] - want) < 1e-9 and got[a, b][1] == len(both)
