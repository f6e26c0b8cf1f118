"""Columns of time labels, dates and calendar features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nullable(c: Column) -> Column:
    return F.when(c != "", c)


def parse_minutes(label: Column) -> Column:
    """Minutes of the day of a label: HH:MM if it has one, else a stand-alone HHMM; hours up to 23; null if neither."""
    colon = r"(?<![0-9])([01]?[0-9]|2[0-3]):([0-5][0-9])(?![0-9])"
    compact = r"(?<![0-9])([01][0-9]|2[0-3])([0-5][0-9])(?![0-9])"
    at = lambda p: nullable(F.regexp_extract(label, p, 1)).cast("bigint") * 60 + nullable(F.regexp_extract(label, p, 2)).cast("bigint")
    return F.coalesce(at(colon), at(compact))


def in_slots(minutes: Column, first: int = 360, last: int = 719) -> Column:
    """Labels that can't be read are kept."""
    return minutes.isNull() | minutes.between(first, last)


def slot_hour(minutes: Column) -> Column:
    return minutes / F.lit(60.0)


def slot_index(minutes: Column, first: int = 360, step: int = 15, slots: int = 24) -> Column:
    i = F.floor((minutes - first) / F.lit(step)).cast("bigint")
    return F.when(i.between(0, slots - 1), i)


def extract_date(text: Column) -> Column:
    return nullable(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0))


def ts_key(date: Column, label: Column) -> Column:
    return F.concat_ws("__", date.cast("string"), label)


def parse_ts_key(key: Column) -> Column:
    """Timestamp (no zone) of a key date__label; null where either part can't be read."""
    day = F.expr("try_cast(null as timestamp_ntz)") if key is None else F.try_to_timestamp(extract_date(F.split_part(key, F.lit("__"), F.lit(1)))).cast("timestamp_ntz")
    return day + F.make_dt_interval(mins=parse_minutes(F.split_part(key, F.lit("__"), F.lit(2))).cast("int"))


def cyclic(hour: Column) -> tuple[Column, Column]:
    return F.sin(2 * F.pi() * hour / 24), F.cos(2 * F.pi() * hour / 24)


def peaks(hour: Column) -> tuple[Column, Column, Column]:
    """Morning (7 to 10) and evening (15 to 18) flags, ends included, and either."""
    m, e = hour.between(7, 10).cast("double"), hour.between(15, 18).cast("double")
    return m, e, F.least(m + e, F.lit(1.0))


def parse_ranges(text: Column) -> Column:
    """"1,3,6-9" as a sorted array of distinct numbers."""
    one = lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("bigint"), F.coalesce(nullable(F.split_part(p, F.lit("-"), F.lit(2))), F.split_part(p, F.lit("-"), F.lit(1))).cast("bigint"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), one))))
