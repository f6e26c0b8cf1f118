"""A task's share of the work doesn't grow with the input."""

import random
import re

from pyspark.sql import functions as F

from tracklane.operators import graphs, series
from tracklane.plans import panels, registry
from tracklane.shared import partitions

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_follow_rows(spark):
    assert partitions(spark.range(1000), 10) == 100 and partitions(spark.range(10), 10) == 4


def test_edge_panel_sums_ranges_of_parts(spark):
    """Lines were joined with lines by part in a shuffle's own number of partitions."""
    plan = optimized(registry.QUERIES["edge_panel"](spark, SF))
    assert "Join" not in plan and "range" in registry.QUERIES["edge_panel"](spark, SF)._jdf.queryExecution().sparkPlan().toString().lower()


def test_edge_panel_of_missing_keys(spark, tmp_path):
    """A line without an edge counts for the edge null, one without a part for none."""
    rows = [(1, 5, "1995-01-03", 4.0), (1, 6, "1995-01-09", 8.0), (1, None, "1995-02-01", 3.0), (2, 5, "1995-01-20", 1.0), (None, 5, "1995-01-20", 99.0)]
    df = spark.createDataFrame(rows, "l_partkey bigint, l_suppkey bigint, l_shipdate string, l_quantity double")
    df.withColumn("l_shipdate", df.l_shipdate.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(str(r.t), r.edge): (r.quantity, r.samples) for r in registry.QUERIES["edge_panel"](spark, str(tmp_path)).collect()}
    jan, feb = "1995-01-01", "1995-02-01"
    assert got == {(jan, 5): (3.5, 3), (jan, 6): (6.0, 2), (jan, None): (6.0, 2), (feb, 5): (3.0, 1), (feb, 6): (3.0, 1), (feb, None): (3.0, 1)}


def test_bridge_join_is_distinct_before_the_join(spark):
    """The joined rows, distinct already, were made distinct once more in few tasks."""
    assert not optimized(registry.QUERIES["bridge_join"](spark, SF)).startswith("Aggregate")


def test_pairs_of_one_large_group_are_many_tasks(spark):
    df = spark.createDataFrame([("x" if i % 10 else "y", i) for i in range(200)] + [(None, 200), ("x", 7)], "g string, i bigint")
    pairs = series.paired(df, "g", "i", band=16, most=1000)
    got = sorted(map(tuple, pairs.selectExpr("a.g", "a.i", "b.i").collect()))
    rows = [tuple(r) for r in df.collect()]
    assert got == sorted((g, i, j) for g, i in rows for h, j in rows if g == h and g and i < j)
    sizes = pairs.rdd.glom().map(len).collect()
    assert max(sizes) < len(got) / 5


def test_distances_of_components_equal_rounds(spark):
    """Rounds of relaxation, each of which sent tables to the driver, ran for components of any size."""
    r = random.Random(3)
    rows = [(r.randrange(40), r.randrange(40), float(r.randrange(4))) for _ in range(90)] + [(90, 91, 2.5), (91, 90, 1.0), (95, 95, 1.0)]
    e = spark.createDataFrame(rows, "u bigint, v bigint, length_m double")
    s = spark.createDataFrame([(i,) for i in [*range(0, 40, 3), 91, 91, 95, 99]], "source bigint")
    near, far = (sorted(map(tuple, graphs.distances(e, s, few=few).collect())) for few in (10_000, 3))
    assert near == far and len(near) > 200
    assert {x[1:] for x in near if x[0] == 91} == {(91, 0.0, 0), (90, 1.0, 1)} and [x for x in near if x[0] > 94] == [(95, 95, 0.0, 0), (99, 99, 0.0, 0)]


def test_chain_of_many_hops_is_few_jobs(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(300)], "u bigint, v bigint, length_m double")
    spark.sparkContext.setJobGroup("chain", "chain")
    assert graphs.distances(e, spark.createDataFrame([(0,)], "source bigint")).count() == 301
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 300


def test_radius_join_of_few_places_is_many_tasks(spark, tmp_path):
    """Pairs of nodes were made where the places met: of few places, in one task."""
    rows = spark.range(3000).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), F.lit("x").alias("s_name"))
    rows.unionByName(rows.limit(1).withColumn("s_suppkey", F.lit(None).cast("bigint"))).write.parquet(f"{tmp_path}/supplier.parquet")
    df = registry.QUERIES["radius_join"](spark, str(tmp_path))
    sizes = df.rdd.glom().map(len).collect()
    assert max(sizes) < sum(sizes) / 2


def test_members_are_pairs_of_nodes_at_places_once(spark):
    r = random.Random(4)
    at = {i: (r.randrange(3), r.randrange(2)) for i in range(70)}
    df = spark.createDataFrame([(i, *p) for i, p in at.items()] + [(None, 1, 1)], "u bigint, x int, y int")
    p = series.spots(df, "u", ["x", "y"], most=5).selectExpr("*", "struct(x, y, part) AS id", "0 AS g")
    assert max(len(x.nodes) for x in p.collect()) < 13
    every = series.met(p, p, "g", ["id"], band=3, most=50).where("a.id <= b.id")
    got = sorted(map(tuple, series.members(every, F.col("a.id") == F.col("b.id"), []).collect()))
    assert got == [(i, j) for i in range(70) for j in range(i + 1, 70)]


def test_edge_panel_ranges_are_a_million_rows(spark, monkeypatch):
    """Ranges of 100,000 rows each sent on their own sum of nearly every month and edge; many ranges give the same rows."""
    ranges = lambda df: int(re.search(r"rangepartitioning\(part.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())[1])
    run = registry.QUERIES["edge_panel"]
    assert ranges(run(spark, "/root/testdata/sf0.1")) == 4  # a shuffle's own number; 6 before
    want = sorted(map(tuple, run(spark, SF).collect()))
    monkeypatch.setattr(panels, "PARTS_ROWS", 500)
    few = run(spark, SF)
    assert ranges(few) == 12 and sorted(map(tuple, few.collect())) == want
