"""The message log: offsets, restarts between commits, bad messages; the feature stage and the covariance of sessions."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.operators import series
from tracklane.streaming import features, log, state, topics


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    log.register(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, features.PROVIDER)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def send(spark, root, topic, rows, partitions=3):
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.format("messages").mode("append").option("path", root).option("topic", topic).option("partitions", partitions).save()


def read(spark, root, topic):
    return spark.read.format("messages").option("path", root).option("subscribe", topic).load()


def test_offsets_are_dense_and_keys_keep_their_order(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    for k in range(3):
        send(spark, root, "raw", [(f"k{i % 5}", f"{k}:{i}\né ") for i in range(40)] + [(None, f"none {k}"), ("x", None)])
    got = read(spark, root, "raw").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.partition, r.offset)):
        by.setdefault(r.partition, []).append(r)
    assert sum(map(len, by.values())) == 3 * 42 and all([r.offset for r in rows] == list(range(len(rows))) for rows in by.values())
    for i in range(5):
        mine = [r.value for r in sorted(got, key=lambda r: r.offset) if r.key == f"k{i}"]
        assert len({r.partition for r in got if r.key == f"k{i}"}) == 1 and mine == [f"{k}:{j}\né " for k in range(3) for j in range(i, 40, 5)]
    assert read(spark, root, "none").count() == 0
    with pytest.raises(Exception, match="messages are"):
        spark.range(1).write.format("messages").mode("append").option("path", root).option("topic", "t").save()


class Killed(Exception):
    pass


def run(spark, stream, put, checkpoint):
    """Until the stream has nothing left or put fails."""
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
    except Exception as e:
        if "Killed" not in str(e):
            raise
        return False
    finally:
        q.stop()
    return True


def test_a_restart_between_commits_gives_each_message_one_effect(spark, tmp_path):
    root, out = str(tmp_path / "log"), str(tmp_path / "out")
    send(spark, root, "t", [(f"k{i % 7}", str(i)) for i in range(100)])
    stream = lambda: spark.readStream.format("messages").option("path", root).option("subscribe", "t").option("group", "g").option("maxOffsetsPerTrigger", 10).load()
    batches = []

    def put(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        batches.append(batch)
        if batch == 2 and batches.count(2) == 1:
            raise Killed("Killed after the write, before the commit")

    assert not run(spark, stream(), put, str(tmp_path / "c"))
    assert batches == [0, 1, 2] and json.loads((tmp_path / "log/_groups/g.done").read_text())["t"]
    send(spark, root, "t", [("k1", str(i)) for i in range(100, 120)])
    assert run(spark, stream(), put, str(tmp_path / "c"))
    assert batches[3] == 2  # the batch that was cut off comes again, with the same messages
    got = spark.read.option("basePath", out).parquet(f"{out}/batch=*").collect()
    assert sorted(int(r.value) for r in got) == list(range(120)) and len({(r.partition, r.offset) for r in got}) == 120
    assert max(spark.read.parquet(f"{out}/batch=0").groupBy("partition").count().toPandas()["count"]) == 10
    # a new query of the group goes on where it has come to
    send(spark, root, "t", [("k1", "last")])
    seen = []
    later = spark.readStream.format("messages").option("path", root).option("subscribe", "t").option("group", "g").option("startingOffsets", "group").load()
    assert run(spark, later, lambda df, b: seen.extend(r.value for r in df.collect()), str(tmp_path / "c2"))
    assert "last" in seen and len(seen) < 120


def test_a_stream_to_a_log_takes_each_batch_once(spark, tmp_path):
    root = str(tmp_path / "log")
    send(spark, root, "a", [(f"k{i}", str(i)) for i in range(30)])
    stream = spark.readStream.format("messages").option("path", root).option("subscribe", "a").load().select("key", "value")
    q = stream.writeStream.format("messages").option("path", root).option("topic", "b").option("query", "q").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    for f in os.listdir(tmp_path / "c" / "commits"):  # as if it had died before the checkpoint knew
        os.remove(tmp_path / "c" / "commits" / f)
    q = stream.writeStream.format("messages").option("path", root).option("topic", "b").option("query", "q").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(int(r.value) for r in read(spark, root, "b").collect()) == list(range(30))


def documents():
    """Jobs of two segments over five days; one result without a speed, one repeated."""
    out = []
    for day in range(1, 6):
        results = [{"timeSet": str(s), "dateRange": "d", "averageSpeed": 20.0 + 3 * s + day * (-1) ** s, "harmonicAverageSpeed": 19.0 + s, "medianSpeed": 21.0 + s, "standardDeviationSpeed": 2.0 + s, "sampleSize": 9.0 if (day, s) == (2, 1) else 30.0} for s in range(4)]
        results += [{"timeSet": "1", "dateRange": "d", "averageSpeed": 99.0, "sampleSize": 50.0}, {"timeSet": "2", "dateRange": "d"}]
        segment = lambda i, r=results: {"segmentId": i, "distance": 10.0, "speedLimit": 50.0, "shape": [{"latitude": 1.0, "longitude": 2.0}], "segmentTimeResults": r}
        out.append({"jobName": f"j{day}", "dateRanges": [{"@id": "d", "name": f"2024-01-0{day}"}], "timeSets": [{"@id": str(s), "name": f"Slot_07{s}0"} for s in range(4)], "network": {"segmentResults": [segment("a"), segment("b")]}})
    return out


def test_the_feature_stage_equals_its_batch_twin(spark, tmp_path):
    root, out, check = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "c")
    rows = lambda m: topics.observations(topics.checked(m)[0])
    stream = lambda: features.stream_features(rows(spark.readStream.format("messages").option("path", root).option("subscribe", "v").option("group", "f").option("maxOffsetsPerTrigger", 3).load()))

    def go():
        q = features.appended(stream(), out, check)
        q.processAllAvailable()
        q.stop()

    for some in (documents()[:2], documents()[2:]):
        texts = spark.createDataFrame([("", json.dumps(j)) for j in some], "source_file string, text string")
        m = [tuple(r) for r in topics.segment_messages(texts).collect()]
        send(spark, root, "v", [*m, ("a", "no json"), ("b", "{}")])
        go()
    want = features.batch_features(rows(read(spark, root, "v")))
    cols = sorted(want.columns)
    table = lambda d: sorted(tuple("null" if v is None else f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in d.select(cols).collect())
    got = features.features_at(spark, out)
    assert table(got) == table(want) and got.count() == 2 * 5 * 4
    assert {c for c in ("relative_speed", "speed_ema", "is_peak", "congestion_index", "speed_volatility")} <= set(cols)
    # a batch that runs again adds nothing
    last = max(int(f) for f in os.listdir(tmp_path / "c" / "commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(tmp_path / "c" / "commits" / f):
            os.remove(tmp_path / "c" / "commits" / f)
    go()
    assert table(features.features_at(spark, out)) == table(want)


@pytest.mark.parametrize("cuts", [[40], [1, 3, 11, 40]])
def test_session_covariances_equal_their_recursion(spark, tmp_path, cuts):
    rng = np.random.default_rng(4)
    x = {s: 40 + rng.standard_normal((20, 5)) @ rng.standard_normal((5, 5)) for s in "ab"}
    rows = [(s, f"2024-01-01 0{6 + k // 12}:{k % 12 * 5:02d}:00", x[s][k].tolist()) for k in range(20) for s in "ab"]
    schema = "session string, t string, x array<double>"
    for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_cov(spark, schema, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0  # no session has ended
    for day in (2, 3):
        spark.createDataFrame([("late", f"2024-01-0{day} 00:00:00", [0.0])], schema).write.mode("append").parquet(str(tmp_path / "in"))
        run_cov(spark, schema, tmp_path)
    got = {(r.session, r.i, r.j): (r.n, r["cov"]) for r in spark.read.parquet(str(tmp_path / "out")).where("session <> 'late'").collect()}
    for s in "ab":
        c = x[s] - x[s].mean(0)
        cov = c.T @ c / len(c)
        for v in c:
            cov = 0.94 * cov + 0.06 * np.outer(v, v)
        for i in range(5):
            for j in range(i, 5):
                n, value = got.pop((s, i, j))
                assert n == 20 and value == pytest.approx(cov[i, j], rel=1e-9)
    assert not got


def run_cov(spark, schema, tmp_path):
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.col("t").cast("timestamp")).withWatermark("at", "1 minute")
    q = state.session_covariance(s, "30 minutes", nodes=5, band=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()


def test_the_recursion_is_that_of_ewma_cov(spark):
    """The state's formula, in plain numbers, against the closed form of the query."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 3))
    d = spark.createDataFrame([(f"n{i}", t, float(x[t, i])) for t in range(30) for i in range(3)], "node string, t bigint, v double")
    w = F.pow(F.lit(0.94), 29 - F.col("t"))
    m = d.groupBy("node").agg(F.avg("v").alias("m"))
    p = series.pairs(d.join(m, "node").withColumn("v", F.col("v") - F.col("m")), "node", "t", "v")
    s = p.groupBy("i", "j").agg((F.covar_pop("x", "y") * 0.94**30 + F.sum(0.06 * w * F.col("x") * F.col("y"))).alias("s")).collect()
    c = x - x.mean(0)
    cov = c.T @ c / 30
    for v in c:
        cov = 0.94 * cov + 0.06 * np.outer(v, v)
    assert all(r.s == pytest.approx(cov[int(r.i[1]), int(r.j[1])]) for r in s)
