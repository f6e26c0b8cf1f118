"""Segment messages: vendor documents as keyed JSON for a topic, and back.

Topics themselves need Spark's Kafka connector on the cluster; what is done to messages works on any stream or table
with key and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.clean import within
from ..sources.jobs import JOB, SEGMENT

MESSAGE = f"struct<jobName:string,dateRanges:array<struct<`@id`:string,name:string,`from`:string,`to`:string>>,timeSets:array<struct<`@id`:string,name:string>>,segment:{SEGMENT}>"


def from_topic(spark: SparkSession, servers: str, topics: str, most: int = 100_000, **options: str) -> DataFrame:
    """A stream of (key, value, topic, partition, offset) from the earliest offsets on; how far a query has read is
    kept in its checkpoint, so each message takes effect once."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most)
    return reader.options(**options).load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset")


def to_topic(messages: DataFrame, servers: str, topic: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Messages (key, value) to a topic: acknowledged by all replicas, compressed, in order for each key."""
    fixed = {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.compression.type": "gzip", "kafka.enable.idempotence": "true", "topic": topic, "checkpointLocation": checkpoint}
    return messages.select("key", "value").writeStream.format("kafka").options(**fixed | options).start()


def segment_messages(texts: DataFrame) -> DataFrame:
    """(key, value) of each segment of documents (source_file, text): the segment with its job's dimensions, keyed by
    its id, so a segment's messages stay in order."""
    j = texts.select(F.from_json("text", JOB).alias("j")).select("j", F.explode("j.network.segmentResults").alias("s"))
    value = F.struct(F.col("j.jobName").alias("jobName"), F.col("j.dateRanges").alias("dateRanges"), F.col("j.timeSets").alias("timeSets"), F.col("s").alias("segment"))
    return j.select(F.coalesce("s.segmentId", "s.newSegmentId").alias("key"), F.to_json(value).alias("value"))


def checked(messages: DataFrame, most_distance: float = 10_000.0, most_speed: float = 120.0) -> tuple[DataFrame, DataFrame]:
    """Good messages (key, m) and rejected ones (key, value, reason). A segment needs an id, a shape and a distance in
    (0, most]; time results with a speed out of bounds are pruned (without one they stay), and one at least must be
    left."""
    m = messages.select("key", "value", F.from_json("value", MESSAGE).alias("m"))
    ok = lambda r: F.coalesce(within(r["averageSpeed"], 0, most_speed), F.lit(False))
    s = F.col("m.segment")
    left = F.filter(s["segmentTimeResults"], ok)
    reason = (
        F.when(s.isNull(), "no segment").when(F.coalesce(s["segmentId"], s["newSegmentId"]).isNull(), "no id").when(F.coalesce(F.size(s["shape"]), F.lit(0)) < 1, "no shape")
        .when(~F.coalesce((s["distance"] > 0) & (s["distance"] <= most_distance), F.lit(False)), "distance").when(F.coalesce(F.size(left), F.lit(0)) < 1, "no time results")
    )
    m = m.withColumn("reason", reason)
    good = m.where("reason is null").select("key", F.col("m").withField("segment.segmentTimeResults", left).alias("m"))
    return good, m.where("reason is not null").select("key", "value", "reason")


def observations(good: DataFrame) -> DataFrame:
    """One row for each time result of good messages, with the labels of its job."""
    r = good.select("key", "m", F.explode("m.segment.segmentTimeResults").alias("r"))
    name = lambda xs, i: F.coalesce(F.try_element_at(F.filter(xs, lambda x: x["@id"] == i), F.lit(1))["name"], i)
    return r.select(
        F.col("m.jobName").alias("job_id"), F.col("key").alias("segment_id"), F.col("m.segment.distance").alias("distance"), F.col("m.segment.frc").alias("frc"), F.col("m.segment.speedLimit").alias("speed_limit"),
        name(F.col("m.dateRanges"), F.col("r.dateRange")).alias("date_range"), name(F.col("m.timeSets"), F.col("r.timeSet")).alias("time_set"),
        F.col("r.averageSpeed").alias("average_speed"), F.col("r.harmonicAverageSpeed").alias("harmonic_average_speed"), F.col("r.medianSpeed").alias("median_speed"), F.col("r.standardDeviationSpeed").alias("std_speed"), F.col("r.sampleSize").alias("sample_size"),
    )
