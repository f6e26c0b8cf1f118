"""Array containers: what is written is read, by batch or whole, with its types."""

import datetime
import decimal
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.sources import arrays

SCHEMA = "b boolean, i tinyint, s smallint, n int, k bigint, f float, d double, t string, day date, at timestamp_ntz, utc timestamp, x decimal(10,2)"


@pytest.fixture
def rows():
    at = datetime.datetime(2024, 2, 29, 23, 59, 59, 123456)
    full = (True, 1, 2, 3, 2**60, 0.5, 1e300, "é\n'", datetime.date(1969, 7, 20), at, at, decimal.Decimal("12.30"))
    return [full, (None,) * 12, (False, -1, -2, -3, -(2**60), -0.5, float("inf"), "", datetime.date(9999, 1, 1), at, at, decimal.Decimal("-0.01"))]


def test_types_come_back(spark, tmp_path, rows):
    arrays.register(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.format("arrays").mode("append").save(str(tmp_path / "d"))
    got = spark.read.format("arrays").load(str(tmp_path / "d"))
    assert got.schema.simpleString() == df.schema.simpleString()
    key = lambda r: str(r)
    assert sorted(got.collect(), key=key) == sorted(df.collect(), key=key)
    part = spark.read.format("arrays").schema("k bigint, other string").load(str(tmp_path / "d"))
    assert sorted((r.k or 0, r.other) for r in part.collect()) == [(-(2**60), None), (0, None), (2**60, None)]
    assert spark.read.format("arrays").load(str(tmp_path / "d")).count() == 3


def test_batches_are_appended_and_the_latest_is_one(spark, tmp_path):
    arrays.register(spark)
    path = f"file://{tmp_path}/log"
    table = spark.range(1000).select("id", (F.col("id") % 7).alias("m"))
    for k in range(3):
        table.where(f"id % 3 = {k}").repartition(2).write.format("arrays").mode("append").option("rows", 100).save(path)
    read = lambda mode: sorted(map(tuple, spark.read.format("arrays").option("mode", mode).load(path).collect()))
    assert read("all") == sorted(map(tuple, table.collect()))
    assert read("latest") == sorted(map(tuple, table.where("id % 3 = 2").collect()))
    assert spark.read.format("arrays").load(path).rdd.getNumPartitions() == 3 * 4
    table.limit(5).write.format("arrays").mode("overwrite").save(path)
    assert len(read("all")) == 5
    with pytest.raises(Exception, match="mode is all or latest"):
        spark.read.format("arrays").option("mode", "some").load(path).count()


def test_files_from_elsewhere_are_read_and_unfinished_batches_are_not(spark, tmp_path):
    arrays.register(spark)
    told = {"columns": ["a", "c"], "dtypes": {"a": "int64", "c": "object"}, "shape": [2, 2], "has_index": True}
    np.savez_compressed(tmp_path / "x_20240101_101010.npz", a=np.array([1, 2]), c=np.array(["p", "q"]), _index=np.arange(2), _metadata=np.array([json.dumps(told)]))
    np.savez(tmp_path / "x_20240101_101011.npz", a=np.array([3], np.int64), c=np.array(["r"]))
    np.savez(tmp_path / "x_20990101_101011_000000_00000_0123abcd.npz", a=np.array([9], np.int64), c=np.array(["never listed"]))
    read = lambda **o: sorted(map(tuple, spark.read.format("arrays").options(**o).load(str(tmp_path)).collect()))
    assert read() == [(1, "p"), (2, "q"), (3, "r")] and read(mode="latest") == [(3, "r")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    arrays.register(spark)
    path = str(tmp_path / "d")
    spark.range(4).write.format("arrays").mode("append").save(path)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("no"))).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("arrays").mode("append").save(path)
    assert spark.read.format("arrays").load(path).count() == 4
    assert not list((tmp_path / "d" / "_staged").glob("*"))
    with pytest.raises(Exception, match="no cells"):
        spark.range(1).select(F.array("id").alias("a")).write.format("arrays").mode("append").save(path)


def test_no_rows_and_no_files(spark, tmp_path):
    arrays.register(spark)
    with pytest.raises(Exception, match="no containers"):
        spark.read.format("arrays").load(str(tmp_path / "none")).count()
    assert spark.read.format("arrays").schema("a int").load(str(tmp_path / "none")).count() == 0
