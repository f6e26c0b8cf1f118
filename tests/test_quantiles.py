"""Quantiles by narrowing against numpy; the best of blocks against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.operators import quantiles as Q
from tracklane.operators import series


@pytest.mark.parametrize("few", [20_000, 3])
def test_quantiles_are_those_of_sorted_values(spark, monkeypatch, few):
    """Spikes, ties, nulls, wide ranges and groups of one value, with ranges that are cut again and again."""
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "PARTS", 16)
    r = np.random.default_rng(3)
    groups = {"a": r.standard_normal(500), "b": np.concatenate([np.zeros(300), r.standard_normal(40) * 1e-9, [1e12, -1e12]]), "c": np.full(7, 2.5), "d": np.array([4.0]), None: r.integers(0, 5, 200).astype(float)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None)] * 9 + [("nulls", None)] * 3
    d = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = Q.quantiles(d, "x", probs, "g")
    assert got.pop("nulls") == [None] * 6
    assert set(got) == set(groups) and all(got[g] == pytest.approx(np.quantile(xs, probs).tolist(), rel=1e-12, abs=1e-300) for g, xs in groups.items())
    every = np.concatenate(list(groups.values()))
    assert Q.quantiles(d, "x", probs)[None] == pytest.approx(np.quantile(every, probs).tolist())
    assert Q.quantiles(d.where("false"), "x", [0.5]) == {None: [None]} and Q.quantiles(d.where("false"), F.col("x"), [0.5], "g") == {}


@pytest.mark.parametrize("absolute", [False, True])
def test_the_best_partners_of_blocks_hold_the_best_of_all(spark, absolute):
    r = np.random.default_rng(1)
    x = np.round(r.standard_normal((12, 6)), 0)  # ties
    rows = [(i, t, float(x[i, t])) for i in range(12) for t in range(6)]
    d = spark.createDataFrame(rows, "node bigint, t bigint, v double")
    order = [F.abs("corr").desc() if absolute else F.desc("corr"), "j"]
    p = series.block_corr(d, "node", "t", "v", 5).select("i", "j", "corr")
    every = p.unionAll(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    best = series.block_top(d, "node", "t", "v", 3, absolute, 5)
    assert best.count() < every.count()
    top = lambda df: sorted((q.i, q.rnk, q.j, round(q["corr"], 12)) for q in series.ranked(df, ["i"], order, 3).collect())
    assert top(best) == top(every)
