"""Stand-in views of the test tables, as DataFrames and as SQL of the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to six decimals, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def obs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    mins = (F.hour("ts") * 60 + F.minute("ts")).cast("bigint")
    start = F.floor(mins / 15) * 15
    label = F.concat(F.lit("Slot_"), F.lpad(F.floor(start / 60).cast("string"), 2, "0"), F.lpad((start % 60).cast("string"), 2, "0"))
    return e.select(
        "event_id", F.col("user_id").alias("segment_id"), "ts", F.col("ts").cast("date").alias("date"), mins.alias("mins"), F.floor(mins / 15).cast("bigint").alias("slot"), label.alias("time_set"),
        F.col("value").alias("speed"), F.col("event_type").alias("frc"), F.get_json_object("props", "$.k").cast("bigint").alias("sample_size"),
    )


OBS = """obs AS (SELECT event_id, user_id AS segment_id, ts, CAST(ts AS DATE) AS date, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS mins,
 CAST((hour(ts) * 60 + minute(ts)) // 15 AS BIGINT) AS slot,
 'Slot_' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || lpad(CAST(minute(ts) // 15 * 15 AS VARCHAR), 2, '0') AS time_set,
 value AS speed, event_type AS frc, CAST(json_extract(props, '$.k') AS BIGINT) AS sample_size FROM events)"""


def panel(spark: SparkSession, d: str, mean: Callable[[str], Column] = F.avg) -> DataFrame:
    """Segment by day: mean speed and sum of samples."""
    return obs(spark, d).groupBy(F.col("segment_id").alias("node"), "date").agg(mean("speed").alias("speed"), F.sum("sample_size").alias("samples"))


PANEL = OBS + ", panel AS (SELECT segment_id AS node, date, AVG(speed) AS speed, CAST(SUM(sample_size) AS BIGINT) AS samples FROM obs GROUP BY 1, 2)"


def types(spark: SparkSession, d: str) -> DataFrame:
    """Event type by day: mean value; complete."""
    return obs(spark, d).groupBy(F.col("frc").alias("node"), "date").agg(F.avg("speed").alias("v"))


TYPES = OBS + ", types AS (SELECT frc AS node, date, AVG(speed) AS v FROM obs GROUP BY 1, 2)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Directed road edges over suppliers, with places by arithmetic of the key."""
    s = table(spark, d, "supplier")
    n = s.agg(F.count("*").alias("n"))
    k = F.col("s_suppkey")
    return s.crossJoin(F.broadcast(n)).select(
        k.alias("u"), ((k * 7 + 3) % F.col("n")).alias("v"), (F.lit(10.76) + (k % 45) / F.lit(1000.0)).alias("lat"), (F.lit(106.675) + (k % 40) / F.lit(1000.0)).alias("lon"),
        (F.lit(50.0) + (k * 37) % 450).alias("length_m"), F.col("s_nationkey").cast("bigint").alias("kind"), F.col("s_name").alias("street"),
    )


EDGES = """edges AS (SELECT s_suppkey AS u, (s_suppkey * 7 + 3) % (SELECT COUNT(*) FROM supplier) AS v, 10.76::DOUBLE + (s_suppkey % 45) / 1000.0::DOUBLE AS lat,
 106.675::DOUBLE + (s_suppkey % 40) / 1000.0::DOUBLE AS lon, 50.0::DOUBLE + (s_suppkey * 37) % 450 AS length_m, CAST(s_nationkey AS BIGINT) AS kind, s_name AS street FROM supplier)"""


def roads(spark: SparkSession, d: str) -> DataFrame:
    """The edges, and a ring through all nodes; nodes 24, 49, ... have no way out."""
    e = edges(spark, d)
    n = e.agg(F.count("*").alias("n"))
    ring = e.select("u").crossJoin(F.broadcast(n)).select("u", ((F.col("u") + 1) % F.col("n")).alias("v"), (F.lit(60.0) + (F.col("u") * 53) % 200).alias("length_m"))
    return e.select("u", "v", "length_m").unionByName(ring).where("u % 25 <> 24")


def places(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select(F.col("u").alias("node"), "lat", "lon")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Probe segments over customers: from near one node to near another a few nodes on."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").crossJoin(F.broadcast(n)).select(F.col("c_custkey").alias("segment"), (F.col("c_custkey") % F.col("n")).alias("a"), ((F.col("c_custkey") + F.col("c_custkey") % 7) % F.col("n")).alias("b"))
    at = lambda k, by: (F.lit(10.76) + (F.col(k) % 45) / F.lit(1000.0) + F.lit(by), F.lit(106.675) + (F.col(k) % 40) / F.lit(1000.0) + F.lit(by))
    (lat_a, lon_a), (lat_b, lon_b) = at("a", 0.0002), at("b", -0.0001)
    c = c.select("segment", lat_a.alias("lat_start"), lon_a.alias("lon_start"), lat_b.alias("lat_end"), lon_b.alias("lon_end"))
    return c.withColumns({"lat": (F.col("lat_start") + F.col("lat_end")) / 2, "lon": (F.col("lon_start") + F.col("lon_end")) / 2})


ROADS = EDGES + """, roads AS (SELECT u, v, MIN(length_m) AS length_m FROM (SELECT u, v, length_m FROM edges UNION ALL
  SELECT u, (u + 1) % (SELECT COUNT(*) FROM edges), 60.0::DOUBLE + (u * 53) % 200 FROM edges) WHERE u % 25 <> 24 AND u <> v GROUP BY 1, 2)"""

SEGMENTS = """segments AS (SELECT *, (lat_start + lat_end) / 2 AS lat, (lon_start + lon_end) / 2 AS lon FROM (SELECT segment, 10.76::DOUBLE + (a % 45) / 1000.0::DOUBLE + 0.0002::DOUBLE AS lat_start, 106.675::DOUBLE + (a % 40) / 1000.0::DOUBLE + 0.0002::DOUBLE AS lon_start,
  10.76::DOUBLE + (b % 45) / 1000.0::DOUBLE - 0.0001::DOUBLE AS lat_end, 106.675::DOUBLE + (b % 40) / 1000.0::DOUBLE - 0.0001::DOUBLE AS lon_end
  FROM (SELECT c_custkey AS segment, c_custkey % n AS a, (c_custkey + c_custkey % 7) % n AS b FROM customer, (SELECT COUNT(*) AS n FROM supplier))))"""
