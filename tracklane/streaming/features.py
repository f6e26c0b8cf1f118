"""The feature stage of the message pipeline: clean rows, features of each segment's own past, and an append that takes
each batch once."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import measures as M
from ..functions import time as T
from ..operators import clean, series

SPEEDS = ["average_speed", "harmonic_average_speed", "median_speed"]
PAST = ["free_flow_speed", "speed_ma_3", "speed_ma_6", "speed_ema", "speed_volatility"]
SPAN = 6
#: The store that states of arbitrary shape need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cleaned(rows: DataFrame) -> DataFrame:
    """Observations (topics.observations) with positive speeds and a sample of ten, in the morning's slots."""
    c = clean.drop_invalid(rows.where("average_speed IS NOT NULL AND segment_id IS NOT NULL"), SPEEDS, "sample_size")
    return c.where(T.in_slots(T.parse_minutes(F.col("time_set"))))


def own_features(rows: DataFrame) -> DataFrame:
    """Features that need a row and its segment's past alone."""
    free, avg, limit = F.col("free_flow_speed"), F.col("average_speed"), F.col("speed_limit")
    hour = T.slot_hour(T.parse_minutes(F.col("time_set")))
    sin, cos = T.cyclic(hour)
    morning, evening, peak = T.peaks(hour)
    more: dict[str, Column] = M.speed_features(avg, F.col("harmonic_average_speed"), F.col("median_speed"), F.col("std_speed"), free, limit)
    more |= {"congestion_index": M.congestion_by_limit(avg, limit), "time_set_sin": sin, "time_set_cos": cos, "is_peak": peak, "is_morning_peak": morning, "is_evening_peak": evening}
    return rows.withColumns(more)


def batch_features(rows: DataFrame) -> DataFrame:
    """The batch twin: cleaned rows, the first of each segment, date and time set, with windows over the segment's
    past in the order of date and time set."""
    keys, order = ["segment_id"], ["date_range", "time_set"]
    r = clean.first_per_key(cleaned(rows), [*keys, *order], ["job_id", "average_speed"])
    w, v = series.past(keys, order), F.col("average_speed")
    sd = F.stddev_samp(v).over(series.last_rows(keys, order, 6))
    r = r.withColumns({
        "free_flow_speed": F.max(v).over(w), "speed_ma_3": F.avg(v).over(series.last_rows(keys, order, 3)), "speed_ma_6": F.avg(v).over(series.last_rows(keys, order, 6)),
        "speed_ema": series.ema("average_speed", w, SPAN), "speed_volatility": F.coalesce(sd, F.lit(0.0)),
    })
    return own_features(r)


class SegmentPast(StatefulProcessor):
    """The last six speeds, the running mean and the highest speed of a segment, and which of its dates and time sets
    have been seen; those are forgotten after a time, which bounds the state."""

    def __init__(self, columns: list[str], keep_ms: int | None):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", "free double, ema double, last array<double>")
        self.seen = handle.getMapState("seen", "date_range string, time_set string", "n int", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(rows)).sort_values(["date_range", "time_set", "job_id", "average_speed"], kind="stable")
        free, ema, last = self.past.get() if self.past.exists() else (0.0, None, [])
        last, a, at, out = deque(last, 6), 2 / (SPAN + 1), [], []
        for i, (day, slot, v) in enumerate(zip(g["date_range"], g["time_set"], g["average_speed"], strict=True)):
            if self.seen.containsKey((day, slot)):
                continue
            self.seen.updateValue((day, slot), (1,))
            last.append(float(v))
            free, ema = max(free, v), v if ema is None else ema * (1 - a) + v * a
            x = list(last)
            mean = sum(x) / len(x)
            sd = math.sqrt(sum((y - mean) ** 2 for y in x) / (len(x) - 1)) if len(x) > 1 else 0.0
            at.append(i)
            out.append((free, sum(x[-3:]) / len(x[-3:]), mean, ema, sd))
        if at:
            self.past.update((float(free), float(ema), list(last)))
            yield pd.concat([g.iloc[at][self.columns].reset_index(drop=True), pd.DataFrame(out, columns=PAST)], axis=1)

    def close(self) -> None:
        pass


def stream_features(rows: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """batch_features() of a stream: the same rows, if a segment's messages come in the order of date and time set,
    however they are cut into batches. Of rows of one date and time set the first that comes counts. Null dates and time
    sets are dropped, as no order has a place for them. Set the session's state store to PROVIDER first."""
    r = cleaned(rows).where("date_range IS NOT NULL AND time_set IS NOT NULL")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema] + [f"{c} double" for c in PAST]
    with_past = r.groupBy("segment_id").transformWithStateInPandas(SegmentPast(r.columns, keep_ms), ", ".join(kinds), "Append", "None" if keep_ms is None else "ProcessingTime")
    return own_features(with_past)


def appended(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream to path, a folder for each batch. A batch that runs again after a failure replaces its own folder,
    so its rows are there once; read with features_at()."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def features_at(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
