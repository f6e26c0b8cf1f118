"""Strategies by name."""

import pytest
from pyspark.sql import functions as F

from tracklane.operators import strategies as S


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, "b"), (9.0, None), (None, "c")], "x double, k string")


@pytest.mark.parametrize(("name", "centre", "width"), [("standard", 4.0, 3.082207001484488), ("minmax", 1.0, 8.0), ("robust", 3.0, 3.5)])
def test_scalers_scale_and_restore(df, name, centre, width):
    s = S.Scaler.fitted(name, df, "x")
    assert (s.centre, s.width) == (centre, pytest.approx(width))
    got = df.select("x", s.scaled("x").alias("z")).select("x", "z", s.restored("z").alias("back")).collect()
    assert all(r.z is None if r.x is None else r.z == pytest.approx((r.x - centre) / width) and r.back == pytest.approx(r.x) for r in got)
    flat = S.Scaler.fitted(name, df.where("x = 1"), "x")
    assert df.select(flat.scaled("x").alias("z")).where("z is not null").count() == 0
    assert S.Scaler.fitted(name, df.where("false"), "x") == S.Scaler(None, None)


def test_encoders_and_aggregates_by_name(df):
    e = S.Encoder.fitted("ordinal", df.where("k <> 'c'"), "k")
    assert sorted(r.code for r in df.select(e.encoded("k")["k"].alias("code")).collect()) == [-1, -1, 0, 1, 1]
    hot = S.Encoder.fitted("onehot", df, "k").encoded("k")
    assert list(hot) == ["k_b", "k_c"] and [tuple(r) for r in df.select(*hot.values()).collect()] == [(1.0, 0.0), (0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    assert df.agg(S.aggregate("median")("x"), S.aggregate("mean")("x")).first()[0:2] == (3.0, 4.0)
    for call in (lambda: S.aggregate("mode"), lambda: S.Scaler.fitted("log", df, "x"), lambda: S.Encoder.fitted("hash", df, "k"), lambda: S.Encoder.fitted("onehot", df, "k", 2)):
        with pytest.raises(ValueError):
            call()
