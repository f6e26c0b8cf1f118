"""Streams give their batch twins' rows; job documents are flattened from files and archives."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.operators import forecast, matrices
from tracklane.sources import jobs, stores
from tracklane.streaming import events, state, topics

JOB = {
    "jobName": "j1", "dateRanges": [{"@id": "1", "name": "2024-01-01"}], "timeSets": [{"@id": "7", "name": "Slot_0715"}],
    "network": {"segmentResults": [
        {"segmentId": 5, "distance": 10.0, "shape": [{"latitude": 1.0, "longitude": 2.0}], "segmentTimeResults": [{"timeSet": 7, "dateRange": 1, "averageSpeed": 30.0}, {"timeSet": 9, "dateRange": 1}]},
        {"newSegmentId": "n6", "segmentTimeResults": [{"timeSet": 7, "dateRange": 1}]},
    ]},
}


def test_jobs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(JOB))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("job_1_results.json", json.dumps(JOB))
    for texts in (jobs.job_texts(spark, str(tmp_path / "a.json")), jobs.zipped_job_texts(spark, str(tmp_path / "b.zip"))):
        got = sorted((r.segment_id, r.date_range, r.time_set, r.average_speed or 0) for r in jobs.flattened(texts).collect())
        assert got == [("5", "2024-01-01", "9", 0), ("5", "2024-01-01", "Slot_0715", 30.0)]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    good, _ = events.validated(events.timed(stream, "60 days"))
    q = events.tumbling(good).writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = events.tumbling(events.validated(batch.withColumn("ts", F.col("ts").cast("timestamp")))[0])
    rows = lambda d: sorted((r.start, r.event_type, r.n, round(r.mean, 6)) for r in d.collect())
    assert rows(spark.table("t")) == rows(want)


def streamed(spark, df, tmp_path, f):
    """The rows that f gives over df's rows as a stream of two batches, the earlier first."""
    for k, part in enumerate((df.where("t < 3"), df.where("t >= 3"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        f(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_running_ema_outlives_batches(spark, tmp_path):
    df = spark.createDataFrame([(k, t, None if (k, t) == ("b", 0) else float(t * t)) for k in "ab" for t in range(6)], "k string, t bigint, v double")
    got = {(r.k, r.t): r.ema for r in streamed(spark, df, tmp_path, lambda s: state.running_ema(s, "k", "t", "v", 3)).collect()}
    last = {}
    for k, t, v in df.orderBy("k", "t").collect():
        if v is not None:
            last[k] = v if k not in last else last[k] / 2 + v / 2
            assert got.pop((k, t)) == pytest.approx(last[k])
    assert not got


def test_running_rls_equals_its_batch_twin(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(s, t, rng.standard_normal(2).tolist()) for s in "ab" for t in range(6)], "session string, t bigint, z array<double>")
    c, phi = np.array([0.1, 0.2]), np.eye(2) / 2
    rows = lambda d: sorted((r.session, r.t, [round(x, 9) for x in r.theta]) for r in d.collect())
    assert rows(streamed(spark, df, tmp_path, lambda s: state.running_rls(s, c, phi))) == rows(forecast.time_varying(df, c, phi))


def test_messages_are_checked_and_flattened(spark):
    job = json.loads(json.dumps(JOB))
    job["network"]["segmentResults"] += [{"segmentId": 7, "distance": 10_001.0, "shape": [{"latitude": 1.0, "longitude": 2.0}]}, {"distance": 1.0}]
    m = topics.segment_messages(spark.createDataFrame([("f", json.dumps(job)), ("g", "{}"), ("h", None)], "source_file string, text string"))
    good, bad = topics.checked(m.unionAll(spark.createDataFrame([("x", "no json")], "key string, value string")))
    assert sorted((r.key or "", r.reason) for r in bad.collect()) == [("", "no id"), ("7", "distance"), ("n6", "no shape"), ("x", "no segment")]
    got = sorted((r.segment_id, r.time_set, r.date_range, r.average_speed) for r in topics.observations(good).collect())
    assert got == [("5", "9", "2024-01-01", None), ("5", "Slot_0715", "2024-01-01", 30.0)]


def test_csv_catalog_and_profile(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, s string")
    stores.write_csv(df, str(tmp_path / "c"))
    assert sorted(stores.read_csv(spark, str(tmp_path / "c"), "k bigint, s string").collect()) == sorted(df.collect(), key=lambda r: r.k)
    (tmp_path / "bom.csv").write_bytes("\ufeffk,s\n5,x\n".encode())
    assert [tuple(r) for r in stores.read_csv(spark, str(tmp_path / "bom.csv"), "k bigint, s string").collect()] == [(5, "x")]
    files = stores.catalog(spark, str(tmp_path), "*.gz")
    assert files.count() >= 1 and stores.latest(files).count() == 1 and files.where("bytes > 0").count() == files.count()
    assert {(r.column, r.n, r.nulls) for r in stores.profile(df).collect()} == {("k", 2, 0), ("s", 2, 1)}
    stores.write_panel(df, str(tmp_path / "p"), "k")
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 1").first().s == "a"


def test_array_containers_and_matrix_bundles(spark, tmp_path):
    df = spark.createDataFrame([("d1", 2, 0.5, "y"), ("d1", 1, 1.5, "x"), ("d2", 1, 2.5, "z")], "day string, t bigint, v double, s string")
    for r in stores.containers(df, ["day"], ["t"]).collect():
        (tmp_path / f"{r.day}.npz").write_bytes(r.content)
    got = {(r.path[-6:-4], r.name): r.numbers or r.texts for r in stores.read_arrays(spark, str(tmp_path)).collect()}
    assert got == {("d1", "t"): [1, 2], ("d1", "v"): [1.5, 0.5], ("d1", "s"): ["x", "y"], ("d2", "t"): [1], ("d2", "v"): [2.5], ("d2", "s"): ["z"]}
    r = spark.createDataFrame([("a", 0, 1, 2, 0.3), ("a", 1, 1, 2, -0.7)], "session string, t bigint, i bigint, j bigint, value double")
    snaps = matrices.snapshots(r, [1, 2])
    for cell, slack in (("half", 1e-3), ("single", 1e-7), ("double", 0)):
        back = matrices.long_rows(stores.unbundled(stores.matrix_bundle(snaps, cell)), [1, 2])
        assert [x.value for x in back.orderBy("t").collect()] == [pytest.approx(0.3, abs=slack), pytest.approx(-0.7, abs=slack)]
    assert stores.bundle_bytes(3697, 64, "half") == 3697 * 3697 * 64 * 2
    with pytest.raises(ValueError):
        stores.bundle_bytes(3697, 64, "half", 10**9)
