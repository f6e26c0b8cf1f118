"""Vendor job documents: nested JSON, alone or in zip archives, as flat observations."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<latitude:double,longitude:double>"
RESULT = "struct<timeSet:string,dateRange:string,harmonicAverageSpeed:double,medianSpeed:double,averageSpeed:double,standardDeviationSpeed:double,averageTravelTime:double,medianTravelTime:double,travelTimeStandardDeviation:double,travelTimeRatio:double,sampleSize:double>"
SEGMENT = f"struct<segmentId:string,newSegmentId:string,streetName:string,distance:double,frc:string,speedLimit:double,shape:array<{POINT}>,segmentTimeResults:array<{RESULT}>>"
JOB = f"struct<jobName:string,dateRanges:array<struct<`@id`:string,name:string,`from`:string,`to`:string>>,timeSets:array<struct<`@id`:string,name:string>>,network:struct<segmentResults:array<{SEGMENT}>>>"


def job_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of each JSON document under a path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def zipped_job_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of each .json member of each archive; members in order of their names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    members = sorted(n for n in z.namelist() if n.endswith(".json"))
                    for m in members:
                        yield pd.DataFrame({"source_file": [f"{name}!{m}"], "text": [z.read(m).decode("utf-8")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source_file string, text string")


def flattened(texts: DataFrame) -> DataFrame:
    """One row for each segment, date range and time set; labels come from the document's own lists, else the id is
    the label; segments without a shape give none."""
    j = texts.select("source_file", F.from_json("text", JOB).alias("j"))
    s = j.select("source_file", "j", F.explode("j.network.segmentResults").alias("s")).where(F.size("s.shape") > 0)
    r = s.select("source_file", "j", "s", F.explode("s.segmentTimeResults").alias("r"))
    name = lambda xs, i: F.coalesce(F.try_element_at(F.filter(xs, lambda x: x["@id"] == i), F.lit(1))["name"], i)
    return r.select(
        "source_file", F.col("j.jobName").alias("job_id"), F.coalesce("s.segmentId", "s.newSegmentId").alias("segment_id"), F.col("s.streetName").alias("street_name"), F.col("s.distance").alias("distance"),
        F.col("s.frc").alias("frc"), F.col("s.speedLimit").alias("speed_limit"), name(F.col("j.dateRanges"), F.col("r.dateRange")).alias("date_range"), name(F.col("j.timeSets"), F.col("r.timeSet")).alias("time_set"),
        F.col("r.averageSpeed").alias("average_speed"), F.col("r.harmonicAverageSpeed").alias("harmonic_average_speed"), F.col("r.medianSpeed").alias("median_speed"), F.col("r.standardDeviationSpeed").alias("std_speed"),
        F.col("r.averageTravelTime").alias("average_travel_time"), F.col("r.travelTimeRatio").alias("travel_time_ratio"), F.col("r.sampleSize").alias("sample_size"), F.col("s.shape").alias("shape"),
    )
