"""Queries of sources, validation, cleaning and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import time as T
from ..operators import clean, series, strategies
from ..shared import shared_dir
from ..sources import arrays, jobs
from .views import EDGES, OBS, PANEL, TYPES, edges, obs, panel, query, r6, table, types


@query("calendar_slots", f"""WITH {OBS}, r AS (SELECT min(date) AS a, max(date) AS b FROM obs)
SELECT CAST(d AS DATE) AS date, CAST(s AS BIGINT) AS slot, 'Slot_' || lpad(CAST((360 + s * 15) // 60 AS VARCHAR), 2, '0') || lpad(CAST((360 + s * 15) % 60 AS VARCHAR), 2, '0') AS time_set
 FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM r), (SELECT unnest(generate_series(0, 23)) AS s)""")
def calendar_slots(spark, d):
    """The slots to be collected for each day from the first to the last that was observed."""
    r = obs(spark, d).agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a IS NOT NULL")
    days = r.select(F.explode(F.sequence("a", "b")).alias("date"))
    m = 360 + F.col("slot") * 15
    out = days.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))))
    return out.select("date", "slot", F.concat(F.lit("Slot_"), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0")).alias("time_set"))


@query("json_flatten", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(j AS BIGINT) AS part FROM events, (SELECT unnest([0, 1]) AS j) WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_flatten(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.where("p.k is not null").select("event_id", F.col("p.k").alias("k"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("part"))


def _log(spark, d):
    """A log of array containers: lineitem in two batches."""
    arrays.register(spark)
    path = f"{shared_dir(spark)}/lineitem-{uuid.uuid4().hex}"
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate")
    for part in ("l_linenumber <= 2", "l_linenumber > 2"):
        l.where(part).write.format("arrays").mode("append").save(path)
    return path


@query("scan_all", "SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_quantity), 6) AS quantity, CAST(MAX(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY 1")
def scan_all(spark, d):
    """All batches of an append log."""
    log = spark.read.format("arrays").load(_log(spark, d))
    return log.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"), F.max("l_shipdate").cast("date").alias("last"))


@query("scan_latest", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_shipdate FROM lineitem WHERE l_linenumber > 2")
def scan_latest(spark, d):
    """The latest batch of an append log, row by row."""
    return spark.read.format("arrays").option("mode", "latest").load(_log(spark, d))


@query("job_scan", f"""WITH {OBS} SELECT 'job-' || segment_id AS job_id, CAST(segment_id AS VARCHAR) AS segment_id, CAST(date AS VARCHAR) AS date_range, CASE WHEN slot % 8 = 5 THEN CAST(slot AS VARCHAR) ELSE time_set END AS time_set, speed AS average_speed, CAST(sample_size AS DOUBLE) AS sample_size
FROM obs WHERE segment_id % 10 <> 0""")
def job_scan(spark, d):
    """Nested job documents, one for each segment, flattened; some time sets have no label, some segments no shape."""
    o = obs(spark, d).withColumn("day", F.unix_date("date").cast("string"))
    result = F.struct(F.col("slot").cast("string").alias("timeSet"), F.col("day").alias("dateRange"), F.col("speed").alias("averageSpeed"), F.col("sample_size").cast("double").alias("sampleSize"))
    g = o.groupBy("segment_id").agg(
        F.collect_list(result).alias("results"),
        F.collect_set(F.struct(F.col("day").alias("@id"), F.col("date").cast("string").alias("name"))).alias("dateRanges"),
        F.collect_set(F.when(F.col("slot") % 8 != 5, F.struct(F.col("slot").cast("string").alias("@id"), F.col("time_set").alias("name")))).alias("timeSets"),
    )
    shape = F.when(F.col("segment_id") % 10 != 0, F.array(F.struct(F.lit(10.7).alias("latitude"), F.lit(106.7).alias("longitude")))).otherwise(F.array())
    segment = F.struct(F.col("segment_id").cast("string").alias("segmentId"), F.lit(12.5).alias("distance"), shape.alias("shape"), F.col("results").alias("segmentTimeResults"))
    job = F.struct(F.concat(F.lit("job-"), F.col("segment_id").cast("string")).alias("jobName"), "dateRanges", "timeSets", F.struct(F.array(segment).alias("segmentResults")).alias("network"))
    flat = jobs.flattened(g.select(F.lit("").alias("source_file"), F.to_json(job).alias("text")))
    return flat.select("job_id", "segment_id", "date_range", "time_set", "average_speed", "sample_size")


@query("first_per_key", "SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1")
def first_per_key(spark, d):
    return clean.first_per_key(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_custkey"])


@query("validate_struct", """SELECT p_partkey, (p_size > 10 AND length(p_name) > 20 AND p_retailprice IS NOT NULL) AS is_valid,
 array_to_string(list_filter([CASE WHEN NOT p_size > 10 THEN 'size' END, CASE WHEN NOT length(p_name) > 20 THEN 'name' END, CASE WHEN p_retailprice IS NULL THEN 'price' END], lambda x: x IS NOT NULL), ',') AS errors FROM part""")
def validate_struct(spark, d):
    ok, errors = clean.errors({"size": F.col("p_size") > 10, "name": F.length("p_name") > 20, "price": F.col("p_retailprice").isNotNull()})
    return table(spark, d, "part").select("p_partkey", ok.alias("is_valid"), F.array_join(errors, ",").alias("errors"))


SHAPES = "shapes AS (SELECT u, v, length_m * 30 AS distance, [{'latitude': lat, 'longitude': lon}, {'latitude': lat + u, 'longitude': lon + 0.01::DOUBLE}, {'latitude': lat - 0.01::DOUBLE, 'longitude': lon}] AS shape FROM edges)"


def shapes(spark, d):
    p = lambda lat, lon: F.struct(lat.alias("latitude"), lon.alias("longitude"))
    lat, lon = F.col("lat"), F.col("lon")
    return edges(spark, d).select("u", "v", (F.col("length_m") * 30).alias("distance"), F.array(p(lat, lon), p(lat + F.col("u"), lon + 0.01), p(lat - 0.01, lon)).alias("shape"))


@query("validate_segment", f"WITH {EDGES}, {SHAPES} SELECT u, (distance > 0 AND distance <= 10000 AND len(list_filter(shape, lambda p: p.latitude NOT BETWEEN -90 AND 90 OR p.longitude NOT BETWEEN -180 AND 180)) = 0) AS is_valid FROM shapes")
def validate_segment(spark, d):
    ok, _ = clean.errors(clean.valid_segment(F.col("distance"), F.col("shape"), F.array("u", "v")))
    return shapes(spark, d).select("u", ok.alias("is_valid"))


@query("shape_stats", f"""WITH {EDGES}, {SHAPES}, g AS (SELECT u, list_filter(shape, lambda p: p.latitude BETWEEN -90 AND 90) AS s FROM shapes)
SELECT u, ROUND(list_avg(list_transform(s, lambda p: p.latitude)), 6) AS lat, ROUND(list_avg(list_transform(s, lambda p: p.longitude)), 6) AS lon, ROUND(s[1].latitude, 6) AS lat_start, ROUND(s[1].longitude, 6) AS lon_start,
 ROUND(s[len(s)].latitude, 6) AS lat_end, ROUND(s[len(s)].longitude, 6) AS lon_end FROM g""")
def shape_stats(spark, d):
    return shapes(spark, d).select("u", *[r6(c).alias(k) for k, c in M.shape_stats(F.col("shape")).items()])


@query("validate_range", f"WITH {OBS} SELECT event_id, (speed IS NULL OR speed BETWEEN 0 AND 120) AND (sample_size IS NULL OR sample_size >= 0) AS is_valid FROM obs")
def validate_range(spark, d):
    return obs(spark, d).select("event_id", (clean.within(F.col("speed"), 0, 120) & clean.within(F.col("sample_size"), 0)).alias("is_valid"))


@query("null_ratio", f"""WITH {OBS}, o AS (SELECT CASE WHEN mins % 3 > 0 THEN speed END AS speed, CASE WHEN mins % 10 > 0 THEN sample_size END AS samples FROM obs),
 c AS (SELECT COUNT(*) AS n, COUNT(*) - COUNT(speed) AS a, COUNT(*) - COUNT(samples) AS b FROM o)
SELECT 'speed' AS "column", a AS nulls, ROUND(a / n::DOUBLE, 6) AS ratio, a / n::DOUBLE > 0.2 AS too_many FROM c UNION ALL SELECT 'samples', b, ROUND(b / n::DOUBLE, 6), b / n::DOUBLE > 0.2 FROM c""")
def null_ratio(spark, d):
    o = obs(spark, d).select(F.when(F.col("mins") % 3 > 0, F.col("speed")).alias("speed"), F.when(F.col("mins") % 10 > 0, F.col("sample_size")).alias("samples"))
    return clean.null_ratios(o, ["speed", "samples"]).withColumn("ratio", r6("ratio"))


@query("clean_filter", f"WITH {OBS} SELECT event_id, speed, sample_size FROM obs WHERE (speed IS NULL OR speed > 0) AND (sample_size IS NULL OR sample_size >= 10)")
def clean_filter(spark, d):
    return clean.drop_invalid(obs(spark, d).select("event_id", "speed", "sample_size"), ["speed"], "sample_size")


@query("unit_convert", f"WITH {EDGES} SELECT u, CASE WHEN (SELECT median(length_m) FROM edges) > 50 THEN length_m / 1000 ELSE length_m END AS length_m FROM edges")
def unit_convert(spark, d):
    return clean.to_kilometres(edges(spark, d).select("u", "length_m"), "length_m")


@query("slot_filter", f"WITH {OBS} SELECT event_id, time_set FROM obs WHERE mins BETWEEN 360 AND 719")
def slot_filter(spark, d):
    return obs(spark, d).where(T.in_slots(T.parse_minutes(F.col("time_set")))).select("event_id", "time_set")


@query("project_contract", f"WITH {OBS} SELECT segment_id, sample_size, frc FROM obs")
def project_contract(spark, d):
    o = obs(spark, d)
    return o.select(*[c for c in ["segment_id", *M.FEATURES] if c in o.columns])


@query("try_cast", "SELECT o_orderkey, COALESCE(TRY_CAST(trim(split_part(o_orderpriority, '-', 1)) AS DOUBLE), 0.0) AS p, COALESCE(TRY_CAST(trim(o_orderstatus) AS DOUBLE), -1.0) AS s FROM orders")
def try_cast(spark, d):
    return table(spark, d, "orders").select("o_orderkey", M.number(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), 0.0).alias("p"), M.number(F.col("o_orderstatus"), -1.0).alias("s"))


@query("coalesce_keys", f"WITH {OBS} SELECT event_id, COALESCE(CASE WHEN sample_size > 50 THEN sample_size END, CASE WHEN mins > 700 THEN mins END, segment_id) AS k FROM obs")
def coalesce_keys(spark, d):
    return obs(spark, d).select("event_id", F.coalesce(F.when(F.col("sample_size") > 50, F.col("sample_size")), F.when(F.col("mins") > 700, F.col("mins")), "segment_id").alias("k"))


@query("select_feature", f"WITH {PANEL}, l AS (SELECT node, date, 'speed' AS feature, speed AS value FROM panel UNION ALL SELECT node, date, 'samples', CAST(samples AS DOUBLE) FROM panel) SELECT node, date, ROUND(value, 6) AS value FROM l WHERE feature = 'speed'")
def select_feature(spark, d):
    long = panel(spark, d).select("node", "date", F.expr("stack(2, 'speed', speed, 'samples', cast(samples as double)) as (feature, value)"))
    return long.where("feature = 'speed'").select("node", "date", r6("value").alias("value"))


@query("parse_minutes", f"WITH {OBS} SELECT event_id, mins // 15 * 15 AS m, CASE WHEN mins // 60 >= 10 THEN mins // 60 * 60 + 5 ELSE mins // 60 * 60 + 5 END AS m2 FROM obs")
def parse_minutes(spark, d):
    text = F.concat(F.lit("at "), F.floor(F.col("mins") / 60).cast("string"), F.lit(":05 h 2359x9"))
    return obs(spark, d).select("event_id", T.parse_minutes(F.col("time_set")).alias("m"), T.parse_minutes(text).alias("m2"))


@query("slot_index", f"WITH {OBS} SELECT event_id, (mins // 15 * 15) / 60.0::DOUBLE AS hour, CASE WHEN mins BETWEEN 360 AND 719 THEN (mins - 360) // 15 END AS slot_index FROM obs")
def slot_index(spark, d):
    m = T.parse_minutes(F.col("time_set"))
    return obs(spark, d).select("event_id", T.slot_hour(m).alias("hour"), T.slot_index(m).alias("slot_index"))


@query("extract_date", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, NULLIF(regexp_extract(props, '\\d{4}-\\d{2}-\\d{2}'), '') AS none FROM events")
def extract_date(spark, d):
    return table(spark, d, "events").select("event_id", T.extract_date(F.concat(F.lit("x"), F.col("ts").cast("string"))).alias("day"), T.extract_date(F.col("props")).alias("none"))


@query("ts_key", f"WITH {OBS} SELECT event_id, CAST(date AS VARCHAR) || '__' || time_set AS key, date_trunc('hour', ts) + to_minutes(minute(ts) // 15 * 15) AS at FROM obs")
def ts_key(spark, d):
    o = obs(spark, d).select("event_id", T.ts_key(F.col("date"), F.col("time_set")).alias("key"))
    return o.withColumn("at", T.parse_ts_key(F.col("key")))


@query("cyclic", f"WITH {OBS} SELECT event_id, ROUND(sin(2 * pi() * mins / 60.0::DOUBLE / 24), 6) + 0.0 AS s, ROUND(cos(2 * pi() * mins / 60.0::DOUBLE / 24), 6) + 0.0 AS c FROM obs")
def cyclic(spark, d):
    s, c = T.cyclic(F.col("mins") / 60)
    return obs(spark, d).select("event_id", r6(s).alias("s"), r6(c).alias("c"))


@query("peak_flags", f"""WITH {OBS}, h AS (SELECT event_id, mins / 60.0::DOUBLE AS h FROM obs) SELECT event_id, CAST(h BETWEEN 7 AND 10 AS DOUBLE) AS morning, CAST(h BETWEEN 15 AND 18 AS DOUBLE) AS evening,
 CAST(h BETWEEN 7 AND 10 OR h BETWEEN 15 AND 18 AS DOUBLE) AS peak FROM h""")
def peak_flags(spark, d):
    m, e, p = T.peaks(F.col("mins") / 60)
    return obs(spark, d).select("event_id", m.alias("morning"), e.alias("evening"), p.alias("peak"))


@query("speed_features", """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax * 100 AS h, l_discount * 100 AS m, l_tax * 50 AS s, l_quantity + 5 AS f, l_discount * 1000 AS lim FROM lineitem)
SELECT l_orderkey, l_linenumber, ROUND(GREATEST(a / GREATEST(f, 1), 0), 6) AS relative_speed, ROUND(LEAST(GREATEST(1 - a / GREATEST(f, 1), 0), 1), 6) AS speed_reduction_ratio, ROUND(GREATEST(a / GREATEST(lim, 1), 0), 6) AS speed_limit_ratio,
 ROUND(ABS(a - h), 6) AS speed_range, ROUND((a - m) / GREATEST(s, 1), 6) AS speed_skewness, ROUND(s / GREATEST(a, 1), 6) AS speed_cv FROM l""")
def speed_features(spark, d):
    q = F.col("l_quantity")
    f = M.speed_features(q, F.col("l_tax") * 100, F.col("l_discount") * 100, F.col("l_tax") * 50, q + 5, F.col("l_discount") * 1000)
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber"), *[r6(c).alias(k) for k, c in f.items()])


@query("congestion_v1", "SELECT o_orderkey, ROUND(GREATEST(0, o_totalprice / GREATEST(o_custkey * 100.0::DOUBLE, 0.001) - 1), 6) AS congestion FROM orders")
def congestion_v1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r6(M.congestion_by_time(F.col("o_totalprice"), F.col("o_custkey") * F.lit(100.0))).alias("congestion"))


@query("congestion_v2", f"WITH {OBS} SELECT event_id, CASE WHEN sample_size > 0 AND speed IS NOT NULL THEN ROUND(GREATEST(0, 1 - speed / sample_size), 6) END AS congestion FROM obs")
def congestion_v2(spark, d):
    return obs(spark, d).select("event_id", r6(M.congestion_by_limit(F.col("speed"), F.col("sample_size"))).alias("congestion"))


DIST = "2 * 6371000.0 * asin(sqrt(LEAST(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def _hops(spark, d):
    e = edges(spark, d)
    return e.alias("a").join(e.alias("b"), F.col("a.v") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("a.v").alias("v"), M.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("m"))


@query("haversine", f"WITH {EDGES} SELECT a.u, a.v, ROUND({DIST}, 3) AS metres FROM edges a JOIN edges b ON a.v = b.u")
def haversine(spark, d):
    return _hops(spark, d).select("u", "v", F.round("m", 3).alias("metres"))


@query("geo_bins", f"WITH {EDGES}, h AS (SELECT a.u, {DIST} AS m FROM edges a JOIN edges b ON a.v = b.u) SELECT u, CASE WHEN m <= 250 THEN '0-250m' WHEN m <= 500 THEN '250-500m' WHEN m <= 1000 THEN '500m-1km' WHEN m <= 2000 THEN '1-2km' WHEN m <= 5000 THEN '2-5km' ELSE '>5km' END AS bin FROM h")
def geo_bins(spark, d):
    return _hops(spark, d).select("u", M.geo_bin(F.col("m")).alias("bin"))


@query("grid_cell", f"WITH {EDGES}, b AS (SELECT MIN(lat) AS a, MAX(lat) AS z, MIN(lon) AS p, MAX(lon) AS q FROM edges) SELECT u, CAST(GREATEST(0, LEAST(9, floor((lat - a) / GREATEST(z - a, 1e-12) * 10))) AS BIGINT) AS row, CAST(GREATEST(0, LEAST(9, floor((lon - p) / GREATEST(q - p, 1e-12) * 10))) AS BIGINT) AS col FROM edges, b")
def grid_cell(spark, d):
    e = edges(spark, d)
    b = e.agg(F.min("lat").alias("a"), F.max("lat").alias("z"), F.min("lon").alias("p"), F.max("lon").alias("q"))
    return e.crossJoin(F.broadcast(b)).select("u", M.grid_cell(F.col("lat"), F.col("a"), F.col("z")).alias("row"), M.grid_cell(F.col("lon"), F.col("p"), F.col("q")).alias("col"))


@query("grid_mean", f"WITH {EDGES}, b AS (SELECT MIN(lat) AS a, MAX(lat) AS z FROM edges), c AS (SELECT CAST(GREATEST(0, LEAST(9, floor((lat - a) / GREATEST(z - a, 1e-12) * 10))) AS BIGINT) AS cell, length_m FROM edges, b) SELECT cell, ROUND(AVG(length_m), 6) AS mean FROM c GROUP BY 1")
def grid_mean(spark, d):
    e = edges(spark, d)
    b = e.agg(F.min("lat").alias("a"), F.max("lat").alias("z"))
    c = e.crossJoin(F.broadcast(b)).select(M.grid_cell(F.col("lat"), F.col("a"), F.col("z")).alias("cell"), "length_m")
    return c.groupBy("cell").agg(r6(F.avg("length_m")).alias("mean"))


@query("parse_speed", "SELECT p_partkey, ROUND(CASE WHEN p_partkey % 3 = 0 THEN p_size * 1.60934::DOUBLE WHEN p_partkey % 3 = 1 THEN p_size ELSE NULL END, 6) AS kmh FROM part")
def parse_speed(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" mph"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(";90"))).otherwise("walk")
    return table(spark, d, "part").select("p_partkey", r6(M.parse_speed(text)).alias("kmh"))


@query("highway_code", "SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 13 WHEN 3 THEN 14 ELSE 14 END AS BIGINT) AS code FROM part")
def highway_code(spark, d):
    kind = F.element_at(F.array(F.lit("motorway"), F.lit("residential"), F.lit("tertiary_link"), F.lit("footway"), F.lit(None)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", M.highway_code(kind).alias("code"))


@query("ordinal_encode", "WITH v AS (SELECT o_orderpriority, ROW_NUMBER() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'F')) SELECT o_orderkey, COALESCE(v.code, -1) AS code FROM orders LEFT JOIN v USING (o_orderpriority)")
def ordinal_encode(spark, d):
    o = table(spark, d, "orders")
    v = o.where("o_orderstatus = 'F'").select("o_orderpriority").distinct().withColumn("code", (F.row_number().over(Window.orderBy("o_orderpriority")) - 1).cast("bigint"))
    return o.join(v, "o_orderpriority", "left").select("o_orderkey", F.coalesce("code", F.lit(-1).cast("bigint")).alias("code"))


@query("onehot", "SELECT o_orderkey, CAST(o_orderstatus = 'O' AS DOUBLE) AS is_o, CAST(o_orderstatus = 'P' AS DOUBLE) AS is_p FROM orders")
def onehot(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[(F.col("o_orderstatus") == x).cast("double").alias(f"is_{x.lower()}") for x in ("O", "P")])


def _scaled(spark, d, name):
    o = obs(spark, d)
    return o.select("event_id", r6(strategies.Scaler.fitted(name, o, "speed").scaled("speed")).alias("x"))


@query("scale_standard", f"WITH {OBS} SELECT event_id, ROUND((speed - (SELECT AVG(speed) FROM obs)) / (SELECT STDDEV_POP(speed) FROM obs), 6) + 0.0 AS x FROM obs")
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query("scale_minmax", f"WITH {OBS} SELECT event_id, ROUND((speed - (SELECT MIN(speed) FROM obs)) / ((SELECT MAX(speed) FROM obs) - (SELECT MIN(speed) FROM obs)), 6) + 0.0 AS x FROM obs")
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query("scale_robust", f"WITH {OBS} SELECT event_id, ROUND((speed - (SELECT median(speed) FROM obs)) / ((SELECT quantile_cont(speed, 0.75) FROM obs) - (SELECT quantile_cont(speed, 0.25) FROM obs)), 6) + 0.0 AS x FROM obs")
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


POS = "pos AS (SELECT node, date, v, ROW_NUMBER() OVER (PARTITION BY node ORDER BY date) - 1 AS pos, COUNT(*) OVER (PARTITION BY node) AS n FROM types), split AS (SELECT *, CASE WHEN pos < floor(n * 0.70::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM pos)"


def _split(spark, d):
    w = Window.partitionBy("node")
    p = types(spark, d).withColumn("pos", (F.row_number().over(w.orderBy("date")) - 1).cast("bigint")).withColumn("n", F.count("*").over(w))
    return p.withColumn("split", series.split_by_position(F.col("pos"), F.col("n")))


@query("split_assign", f"WITH {TYPES}, {POS} SELECT node, date, pos, split FROM split")
def split_assign(spark, d):
    return _split(spark, d).select("node", "date", "pos", "split")


@query("train_scale", f"WITH {TYPES}, {POS}, s AS (SELECT AVG(v) AS m, STDDEV_POP(v) AS s FROM split WHERE split = 'train') SELECT node, date, ROUND((v - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END, 6) + 0.0 AS x FROM split, s")
def train_scale(spark, d):
    p = _split(spark, d)
    s = p.where("split = 'train'").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return p.crossJoin(F.broadcast(s)).select("node", "date", r6((F.col("v") - F.col("m")) / F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s"))).alias("x"))


@query("window_split", f"WITH {TYPES}, {POS} SELECT a.node, a.pos AS start_pos, COALESCE(b.split, 'test') AS split FROM split a LEFT JOIN split b ON a.node = b.node AND b.pos = a.pos + 9")
def window_split(spark, d):
    p = _split(spark, d)
    b = p.select("node", (F.col("pos") - 9).alias("start_pos"), "split")
    return p.select("node", F.col("pos").alias("start_pos")).join(b, ["node", "start_pos"], "left").select("node", "start_pos", F.coalesce("split", F.lit("test")).alias("split"))


@query("json_roundtrip", "SELECT r_regionkey, r_name AS name, CAST(r_regionkey * 2 AS BIGINT) AS twice FROM region")
def json_roundtrip(spark, d):
    j = table(spark, d, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("name"), (F.col("r_regionkey") * 2).alias("twice"))).alias("j"))
    return j.select("r_regionkey", F.from_json("j", "name string, twice bigint").alias("x")).select("r_regionkey", "x.*")


@query("edge_id", f"WITH {EDGES} SELECT u || '_' || v AS edge_id, u * (SELECT COUNT(*) FROM edges) + v AS code FROM edges")
def edge_id(spark, d):
    e = edges(spark, d)
    return e.crossJoin(F.broadcast(e.agg(F.count("*").alias("n")))).select(F.concat_ws("_", "u", "v").alias("edge_id"), (F.col("u") * F.col("n") + F.col("v")).alias("code"))


@query("parse_ranges", "SELECT r_regionkey, CAST(x AS BIGINT) AS x FROM region, (SELECT unnest([1, 3, 6, 7, 8, 9]) AS x)")
def parse_ranges(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.explode(T.parse_ranges(F.lit("6-9,1,3,8"))).alias("x"))
