"""Models recover what was planted; projections and groups have the properties that define them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklane.operators import forecast, graphs, matrices

RNG = np.random.default_rng(7)


def latents(spark, zs, session="a"):
    rows = [(session if isinstance(session, str) else session[k], k, [float(x) for x in z]) for k, z in enumerate(zs)]
    return spark.createDataFrame(rows, "session string, t bigint, z array<double>")


def walk(phi, c, n, noise):
    z = [np.zeros(len(c))]
    for _ in range(n):
        z.append(c + phi @ z[-1] + noise * RNG.standard_normal(len(c)))
    return z


PHI = np.array([[0.6, 0.2], [-0.1, 0.5]])


def test_ridge_var_finds_the_transition_and_sessions_do_not_meet(spark):
    z = walk(PHI, np.array([1.0, -1.0]), 400, 0.3)
    c, phi = forecast.ridge_var(latents(spark, z), 2, 1e-6)
    assert np.abs(phi - PHI).max() < 0.1 and np.abs(c - [1, -1]).max() < 0.2
    alone = latents(spark, z[:4], ["a", "b", "c", "d"])
    assert not forecast.ridge_var(alone, 2)[1].any()


def test_stable_caps_the_radius():
    assert np.abs(np.linalg.eigvals(forecast.stable(2 * np.eye(3)))).max() == pytest.approx(0.98)
    assert (forecast.stable(PHI) == PHI).all()


def test_matrix_autoregression_finds_both_sides(spark):
    a, b = np.array([[0.7, 0.1], [0.0, 0.6]]), np.array([[0.9, -0.2, 0.0], [0.1, 0.8, 0.1], [0.0, 0.0, 0.7]])
    x = [RNG.standard_normal((2, 3))]
    for _ in range(500):
        x.append(a @ x[-1] @ b.T + 0.5 * RNG.standard_normal((2, 3)))
    p, q = forecast.matrix_autoregression(latents(spark, [m.ravel() for m in x]), 2, 3, 1e-6)
    assert np.abs(np.kron(p, q) - np.kron(a, b)).max() < 0.12
    assert np.linalg.norm(p) == pytest.approx(1)


def relations(spark, of):
    rows = [("a", t, i, j, float(m[i, j])) for t, m in enumerate(of) for i in range(len(m)) for j in range(len(m)) if i < j]
    return spark.createDataFrame(rows, "session string, t bigint, i bigint, j bigint, value double")


def test_pair_factors_restore_low_rank_relations(spark):
    p, q, mean = (lambda m: (m + m.T) / 2)(RNG.standard_normal((6, 6))), (lambda m: (m + m.T) / 2)(RNG.standard_normal((6, 6))), np.ones((6, 6))
    turn = 0.9 * np.array([[np.cos(0.7), -np.sin(0.7)], [np.sin(0.7), np.cos(0.7)]])
    f = walk(turn, np.zeros(2), 0, 0)
    f = [np.array([3.0, 1.0])]
    for _ in range(60):
        f.append(turn @ f[-1])
    r = relations(spark, [mean + x * p + y * q for x, y in f])
    got = forecast.factor_forecast(forecast.pair_factors(r.drop("session"), 2, 1e-9), r.drop("session"), [1]).where("t < 30").withColumn("t", F.col("t") + 1)
    off = got.join(r.withColumnRenamed("value", "true"), ["t", "i", "j"]).agg(F.max(F.abs(F.col("value") - F.col("true")))).first()[0]
    assert off < 0.2


def test_factorised_snapshots_restore_low_rank_ones(spark):
    u = np.linalg.qr(RNG.standard_normal((5, 2)))[0]
    ms = [u @ np.diag(x) @ u.T for x in RNG.uniform(1, 2, (12, 2))]
    r = spark.createDataFrame([("a", t, i, j, float(m[i, j])) for t, m in enumerate(ms) for i in range(5) for j in range(5)], "session string, t bigint, i bigint, j bigint, value double")
    nodes = matrices.node_list(r)
    snaps = matrices.snapshots(r, nodes, mirrored=False, diagonal=0.0)
    for bases in (forecast.symmetric_bases(snaps, 5, 5), forecast.directed_bases(snaps, 5, 5)):
        for row in forecast.compressed(snaps, bases).collect():
            want = ms[row["t"]] * (1 - np.eye(5))
            assert np.allclose(forecast.restored(np.array(row["z"]), bases), want, atol=1e-9)
            x = np.arange(5.0)
            assert np.allclose(forecast.action(bases, np.array(row["z"]), x), want @ x)


def test_recursive_least_squares_follow_a_change(spark):
    z = walk(np.array([[0.9]]), np.array([0.0]), 200, 1.0)
    for _ in range(200):
        z.append(np.array([-0.9 * z[-1][0]]) + RNG.standard_normal(1))
    got = forecast.time_varying(latents(spark, z), np.zeros(1), np.zeros((1, 1)), 1e-2, 0.95).orderBy("t").collect()
    assert got[0]["theta"] == [0.0, 0.0] and got[200]["theta"][1] > 0.6 and got[-1]["theta"][1] < -0.6


def test_target_regression_keeps_four_and_forecasts(spark):
    gs = [RNG.standard_normal((6, 6))]
    for _ in range(40):
        gs.append(0.5 * gs[-1] + 0.3 * gs[-1].T + 0.01 * RNG.standard_normal((6, 6)))
    r = spark.createDataFrame([("a", t, i, j, float(m[i, j])) for t, m in enumerate(gs) for i in range(6) for j in range(6)], "session string, t bigint, i bigint, j bigint, value double")
    snaps = matrices.snapshots(r, list(range(6)), mirrored=False, diagonal=0.0)
    beta = forecast.target_regression(snaps, 6, 1e-6)
    assert ((beta[:, 1:] != 0).sum(1) <= 4).all() and np.abs(beta[:, 1] - 0.5).max() < 0.1 and np.abs(beta[:, 2] - 0.3).max() < 0.1


def test_elastic_net_meets_its_optimality_conditions(spark):
    x = RNG.standard_normal((200, 6))
    w0 = np.zeros((6, 3))
    w0[:2] = RNG.standard_normal((2, 3))
    y = x @ w0 + 2 + 0.1 * RNG.standard_normal((200, 3))
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b))) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>")
    alpha, ratio = 0.2, 0.5
    c, w = forecast.elastic_net(df, 6, 3, alpha, ratio)
    slope = (x - x.mean(0)).T @ (y - c - x @ w) / 200 - alpha * (1 - ratio) * w
    for g, row in zip(slope, w, strict=True):
        size = np.linalg.norm(row)
        assert np.linalg.norm(g) <= alpha * ratio + 1e-6
        if size:
            assert np.allclose(g, alpha * ratio * row / size, atol=1e-5)
    assert not w[3:].any()
    assert not forecast.elastic_net(df.limit(0), 6, 3)[1].any()


def test_arma_of_short_constant_and_autoregressive_series():
    assert list(forecast.arma(np.array([]), 2)) == [0.0, 0.0] and list(forecast.arma(np.ones(50), 2)) == [1.0, 1.0]
    v = [x[0] for x in walk(np.array([[0.8]]), np.array([1.0]), 800, 0.5)]
    ahead = forecast.arma(np.array(v), 40)
    assert abs(ahead[-1] - 5) < 0.8 and abs(ahead[0] - (1 + 0.8 * v[-1])) < 0.5


def test_nearest_correlation():
    m = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    x = matrices.nearest_correlation(m)
    assert np.allclose(np.diag(x), 1) and np.linalg.eigvalsh(x).min() > -1e-9
    assert np.allclose(matrices.nearest_correlation(np.eye(3)), np.eye(3))


def test_snapshots_of_gaps_nulls_and_repeats(spark):
    r = spark.createDataFrame([("a", 1, 1, 2, 0.5), ("a", 1, 1, 2, 0.25), ("a", 2, 1, 3, None), ("a", 2, None, 3, 1.0)], "session string, t bigint, i bigint, j bigint, value double")
    nodes = matrices.node_list(r.where("i is not null"))
    got = {x["t"]: np.array(x["m"]).reshape(3, 3) for x in matrices.snapshots(r, nodes).collect()}
    assert got[1][0, 1] == got[1][1, 0] == 0.5 and (got[2] == np.eye(3)).all()
    assert matrices.node_list(r.limit(0)) == []
    with pytest.raises(ValueError):
        matrices.node_list(r, 2)


def test_laplacian_vectors_and_regions_split_two_groups():
    a = np.kron(np.eye(2), np.ones((4, 4)))
    a[3, 4] = a[4, 3] = 0.1
    v = matrices.laplacian_vectors(a, 12)
    assert v.shape == (8, 12) and not v[:, 8:].any() and len(set(np.sign(v[:4, 1]))) == 1 and np.sign(v[0, 1]) != np.sign(v[7, 1])
    assert list(matrices.regions(a, 2)) == [0] * 4 + [1] * 4


def test_communities_of_two_cliques_and_a_pair(spark):
    e = [(a, b) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(4, 5), (20, 21), (20, 20), (1, 0)]
    df = spark.createDataFrame(e, "u bigint, v bigint")
    got = graphs.communities(df)
    label = {r["node"]: r["community"] for r in got.collect()}
    assert label == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 10), 5), 20: 20, 21: 20}
    m = 22
    want = sum(own / m - (k / (2 * m)) ** 2 for own, k in ((10, 21), (10, 21), (1, 2)))
    assert graphs.modularity(df, got).first()[0] == pytest.approx(want)
    assert {r["node"]: r["community"] for r in graphs.communities(df, 5).collect()} == label


@pytest.mark.parametrize("kind", ["planted", "hub"])
def test_rounds_of_joins_find_communities_as_good_as_one_task(spark, kind):
    """Four planted groups; a hub of forty leaves, some of them linked, which takes many of them in a round."""
    r = np.random.default_rng(3)
    if kind == "planted":
        e = [(a, b) for a in range(48) for b in range(a) if r.random() < (0.5 if a // 12 == b // 12 else 0.03)]
    else:
        e = [(0, i) for i in range(1, 41)] + [(i, i + 1) for i in range(1, 40, 5)] + [(100, 101), (101, 102), (100, 102), (100, 40)]
    df = spark.createDataFrame(e, "u bigint, v bigint")
    one, rounds = graphs.communities(df), graphs.communities(df, 0)
    score = [graphs.modularity(df, x).first()[0] for x in (one, rounds)]
    assert score[1] >= score[0] - 0.02 and score[1] > 0.1
    named = rounds.groupBy("community").agg(F.min("node").alias("least"), F.count("*").alias("n")).collect()
    assert all(x.community == x.least for x in named) and sum(x.n for x in named) == len({x for p in e for x in p})


def test_zones_keep_the_base_and_rank_the_rest(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)], "u bigint, v bigint")
    places = spark.createDataFrame([(k, 10.0 + k / 1000, 106.0) for k in range(9)], "node bigint, lat double, lon double")
    links = spark.createDataFrame([(2, 3, 5.0, 0), (2, 4, 9.0, 1), (1, 3, 7.0, 9)], "i bigint, j bigint, weight double, tau bigint")
    seeds = spark.createDataFrame([(0,)], "node bigint")
    got = lambda most: {(r["node"], r["score"], r["base"]) for r in graphs.zones(edges, places, links, seeds, 300.0, (1.0, 500.0), 1.0, 2, most).collect()}
    base = {(0, None, True), (1, None, True), (2, None, True)}
    assert got(9) == base | {(3, 5.0, False), (4, 9.0, False)}
    assert got(4) == base | {(4, 9.0, False)} and got(1) == base


def test_matrix_sum_of_an_empty_table(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0]})).limit(0)
    assert not matrices.matrix_sum(df, lambda b: np.ones((2, 2)), (2, 2)).any()
