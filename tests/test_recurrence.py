"""Recurrences over ranges of rows against a walk through them."""

import random

import pytest

from tracklane.operators import recurrence


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_exponential_means_of_keys_in_many_ranges(spark, ranges):
    """A key of most rows, keys of one row, null keys and values, and ranges that begin with nulls."""
    r = random.Random(5)
    rows = [("hot" if i % 4 else r.choice(["a", None, f"k{i}"]), i, None if r.random() < 0.3 or 100 < i < 160 else r.uniform(-9, 9), "y") for i in range(400)]
    rows += [("nulls", i, None, "") for i in range(20)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "k string, t long, x double, y string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {(x.k, x.t): x.ema for x in recurrence.exponential_mean(d, ["k"], ["t"], "x", "ema", 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    last = {}
    for k, t, x, _ in sorted(rows, key=lambda x: x[1]):
        if x is not None:
            last[k] = x if k not in last else last[k] / 2 + x / 2
        want = last.get(k)
        assert got.pop((k, t)) == (None if want is None else pytest.approx(want, abs=1e-12))
    assert not got


def test_a_mean_of_nothing(spark):
    assert recurrence.exponential_mean(spark.createDataFrame([], "k string, t long, x double"), ["k"], ["t"], "x", "e").collect() == []
