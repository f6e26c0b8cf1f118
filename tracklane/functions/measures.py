"""Columns of speeds, congestion, geometry and road attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Highway classes and their codes; unknown classes are 14.
HIGHWAY_CODES = {
    "motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "residential": 5, "service": 6, "unclassified": 7,
    "living_street": 8, "motorway_link": 9, "trunk_link": 10, "primary_link": 11, "secondary_link": 12, "tertiary_link": 13, "other": 14,
}

# The feature contract, in order.
FEATURES = [
    "average_speed", "harmonic_average_speed", "median_speed", "std_speed", "average_travel_time", "travel_time_ratio", "sample_size",
    "relative_speed", "speed_reduction_ratio", "speed_limit_ratio", "speed_range", "speed_skewness", "speed_cv",
    "congestion_index", "free_flow_speed", "free_flow_travel_time",
    "time_set_sin", "time_set_cos", "is_peak", "is_morning_peak", "is_evening_peak",
    "speed_ma_3", "speed_ma_6", "speed_ema", "speed_volatility", "distance", "frc", "speed_limit",
]

# Upper ends in metres of the labelled distance bins, right-closed.
GEO_BINS = [(250, "0-250m"), (500, "250-500m"), (1000, "500m-1km"), (2000, "1-2km"), (5000, "2-5km"), (None, ">5km")]


def clipped(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null."""
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def ratio(x: Column, y: Column, floor: float = 1.0) -> Column:
    return F.when(y.isNotNull(), x / F.greatest(y, F.lit(floor)))


def speed_features(avg: Column, harmonic: Column, median: Column, std: Column, free: Column, limit: Column) -> dict[str, Column]:
    return {
        "relative_speed": clipped(ratio(avg, free), 0.0),
        "speed_reduction_ratio": clipped(F.lit(1.0) - ratio(avg, free), 0.0, 1.0),
        "speed_limit_ratio": clipped(ratio(avg, limit), 0.0),
        "speed_range": F.abs(avg - harmonic),
        "speed_skewness": ratio(avg - median, std),
        "speed_cv": ratio(std, avg),
    }


def congestion_by_time(travel: Column, free: Column) -> Column:
    """Excess of the travel time over the free-flow one."""
    return clipped(ratio(travel, free, 0.001) - 1, 0.0)


def congestion_by_limit(speed: Column, limit: Column) -> Column:
    """Shortfall of the speed below the limit; null without a positive limit."""
    return F.when((limit > 0) & speed.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - speed / limit))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def geo_bin(metres: Column) -> Column:
    out = F.lit(GEO_BINS[-1][1])
    for top, label in reversed(GEO_BINS[:-1]):
        out = F.when(metres <= top, label).otherwise(out)
    return F.when(metres.isNotNull(), out)


def grid_cell(x: Column, low: Column, high: Column, n: int = 10) -> Column:
    """Index of x among n cells of equal width, the ends clipped."""
    i = F.floor((x - low) / F.greatest(high - low, F.lit(1e-12)) * n).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(n - 1).cast("bigint"), i))


def parse_speed(text: Column) -> Column:
    """Kilometres an hour of "50", "30 mph" or "50;60" (the first counts)."""
    first = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1)
    v = F.when(first != "", first.cast("double"))
    return F.when(F.contains(F.lower(text), F.lit("mph")), v * 1.60934).otherwise(v)


def highway_code(kind: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in HIGHWAY_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, F.coalesce(kind, F.lit("other"))), F.lit(HIGHWAY_CODES["other"])).cast("bigint")


def number(text: Column, default: float | None = None) -> Column:
    """A lenient cast: blanks and what is no number give the default."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default).cast("double"))


def shape_points(shape: Column) -> Column:
    """Points of a polyline within the globe, as (latitude, longitude)."""
    return F.filter(shape, lambda p: p["latitude"].between(-90, 90) & p["longitude"].between(-180, 180))


def shape_stats(shape: Column) -> dict[str, Column]:
    pts = shape_points(shape)
    mean = lambda f: F.try_divide(F.aggregate(pts, F.lit(0.0), lambda a, p: a + p[f]), F.size(pts))
    end = lambda i, f: F.try_element_at(pts, F.lit(i))[f]
    return {"lat": mean("latitude"), "lon": mean("longitude"), "lat_start": end(1, "latitude"), "lon_start": end(1, "longitude"), "lat_end": end(-1, "latitude"), "lon_end": end(-1, "longitude")}
