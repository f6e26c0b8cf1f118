"""Stores of tables, arrays and matrices. Files are read and written by Spark alone, so that any store it knows will do."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a matrix cell is stored as.
CELLS = {"half": "<f2", "single": "<f4", "double": "<f8"}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line, plain or compressed; a byte-order mark before the first name is no part of it."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("compression", "gzip").csv(path)


def write_panel(df: DataFrame, path: str, by: str = "date", mode: str = "errorifexists") -> None:
    """Parquet with a folder for each value of by, whose rows go to one or several tasks as AQE sees fit: a date with
    most of the rows is split."""
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n, nulls, distinct) of every column that can be compared; distinct is approximate."""
    cols = [f for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    cells = df.agg(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("n"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"), F.approx_count_distinct(F.col(f"`{f.name}`")).alias("distinct")).alias(f"c{k}") for k, f in enumerate(cols)])
    return cells.select(F.inline(F.array(*[f"c{k}" for k in range(len(cols))])))


def catalog(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of the files under a path whose names fit; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def latest(files: DataFrame) -> DataFrame:
    """The row of catalog() modified last; ties: the last path."""
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(1)


ARRAYS = "path string, name string, dtype string, shape array<bigint>, numbers array<double>, texts array<string>"


def read_arrays(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """One row for each array of each .npz container: its shape and its cells row by row, as numbers or, for arrays
    of strings, as texts. Pickled objects are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in z.files if names is None else [n for n in names if n in z.files]:
                        a = z[name]
                        plain = a.dtype.kind in "biuf"
                        yield pd.DataFrame({"path": [where], "name": [name], "dtype": [a.dtype.str], "shape": [list(a.shape)], "numbers": [a.ravel().astype(float) if plain else None], "texts": [None if plain else a.ravel().astype(str).tolist()]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInPandas(run, ARRAYS)


def containers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, n, content): one compressed .npz container for each group, an array for each other column, rows in order.
    A group is one task's work, such as a day of a segment set; write the rows as a table of binaries."""
    cols = [c for c in df.columns if c not in by]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, out = g.sort_values(order, kind="stable"), io.BytesIO()
        np.savez_compressed(out, **{c: g[c].astype(str).to_numpy(str) if g[c].dtype == object else g[c].to_numpy() for c in cols})
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in by}, "n": [len(g)], "content": [out.getvalue()]})

    return df.groupBy(*by).applyInPandas(run, f"{kinds}, n bigint, content binary")


def matrix_bundle(snaps: DataFrame, cell: str = "single") -> DataFrame:
    """(session, t, n, cell, data) of snapshots (session, t, m): the n by n cells as little-endian bytes."""
    kind = CELLS[cell]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"session": b["session"], "t": b["t"], "n": [int(len(m) ** 0.5 + 0.5) for m in b["m"]], "cell": cell, "data": [np.asarray(m).astype(kind).tobytes() for m in b["m"]]})

    return snaps.mapInPandas(run, "session string, t bigint, n bigint, cell string, data binary")


def unbundled(bundle: DataFrame) -> DataFrame:
    """Snapshots (session, t, m) of a bundle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"session": b["session"], "t": b["t"], "m": [np.frombuffer(d, CELLS[c]).astype(float) for d, c in zip(b["data"], b["cell"], strict=True)]})

    return bundle.mapInPandas(run, "session string, t bigint, m array<double>")


def bundle_bytes(nodes: int, snapshots: int, cell: str = "single", most: int | None = None) -> int:
    """What a bundle takes before compression; an error if that is over most."""
    size = nodes * nodes * snapshots * int(CELLS[cell][-1])
    if most is not None and size > most:
        raise ValueError(f"{size} bytes for {nodes} nodes and {snapshots} snapshots; at most {most}")
    return size
