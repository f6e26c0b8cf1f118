"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges that a task contracts at once.
SLICE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session that names none gets a temporary
    folder; elsewhere that is an error, since executors can't see each other's local folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracklane-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def written(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage is cut and lost executors cost one reread.
    The table's path is appended to keep, for dropped()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def partitions(df: DataFrame, rows: int) -> int:
    """How many partitions give each about that many rows of df, and a shuffle's own number at least; counts df."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def contracted(v: np.ndarray, u: np.ndarray) -> pd.DataFrame:
    """The components of these edges as edges (v, u) from each node to its component's smallest, that one left out."""
    nodes, code = np.unique(np.concatenate((v, u)), return_inverse=True)
    a, b, root = code[: len(v)], code[len(v) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"v": nodes[below], "u": nodes[root[below]]})


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """contracted() edges, SLICE (and a batch) at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= SLICE:
            x = pd.concat(held)
            yield contracted(x["v"].to_numpy(), x["u"].to_numpy())
            held = []
    if held:
        x = pd.concat(held)
        yield contracted(x["v"].to_numpy(), x["u"].to_numpy())


def components(edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of the component.

    Tasks first contract slices of SLICE edges; where one slice has them all, as few jobs do it as it takes to write
    them. What several slices leave is joined by alternating large-star and small-star steps (a number of rounds logarithmic in the size of a component).
    Each step is a minimum by node, combined before the shuffle, and an equi-join, whose hot keys AQE splits;
    each round's edges are a table in the shared folder; the last one's path is appended to keep. Nulls and self-links
    are ignored.
    """
    spark = edges.sparkSession
    old: list[str] = []
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()
    e = written(e, now := [])
    one = False
    if e.schema["v"].dataType.typeName() in ("integer", "long", "string"):
        one = e.count() < SLICE
        old += now
        e = written((e.coalesce(1) if one else e).mapInPandas(_slices, e.schema), now := [])
        dropped(spark, old)
    before = None
    while not one:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself)
        both = e.select("v", "u").unionAll(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        # small star: a node's smaller neighbours and itself are linked to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        e = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(low.select("v", F.col("m").alias("u"))).where("u < v").distinct()
        old += now
        e = written(e, now := [])
        after = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, old)
        if after == before:
            break
        before = after
    if keep is not None:
        keep += now
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(roots)
