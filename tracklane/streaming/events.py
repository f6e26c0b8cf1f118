"""Streams of observations: validation and event-time windows. The same functions run over batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import within


def timed(events: DataFrame, late: str = "1 hour", column: str = "ts") -> DataFrame:
    """Event time as TIMESTAMP with a watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def validated(events: DataFrame, speed: str = "value", most: float = 120.0) -> tuple[DataFrame, DataFrame]:
    """Rows whose speed is null or within bounds, and the rejected ones."""
    ok = F.coalesce(within(F.col(speed), 0, most), F.lit(False))
    return events.where(ok), events.where(~ok)


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first of repeated events within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, width: str = "1 hour", by: str = "event_type", value: str = "value") -> DataFrame:
    w = events.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("w.start").alias("start"), by, "n", "mean")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", by: str = "user_id") -> DataFrame:
    return events.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")
