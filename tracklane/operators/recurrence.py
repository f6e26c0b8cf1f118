"""Linear recurrences over ordered rows of a key, as an associative scan over ranges of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def _scanned(keys: int, decay: float):
    """A sorted range's rows with __y, the recurrence within the range, and for the range's first key, which may have
    begun in a range before, __a, what that adds for each unit it ended at; every key but the first starts with its
    first value. The last row of each task's range has __end."""
    rest = 1 - decay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = y = start = None
        a, first, began, held = 1.0, True, False, None
        for b in batches:
            if not b.num_rows:
                continue
            names = list(zip(*[b.column(i).to_pylist() for i in range(keys)], strict=True))
            ys, prods, starts = [], [], []
            for k, x in zip(names, b.column(keys).to_pylist(), strict=True):
                if not began or k != key:
                    first = not began
                    key, began, y, a, start = k, True, (0.0 if first else None), 1.0, None
                if x is not None:
                    if first:
                        y, a = decay * y + rest * x, a * decay
                        start = x if start is None else start
                    else:
                        y = x if y is None else decay * y + rest * x
                ys.append(y)
                prods.append(a if first else None)
                starts.append(start if first else None)
            if held is not None:
                yield held
            n = b.num_rows
            held = pa.RecordBatch.from_arrays([*b.columns, pa.array(ys, pa.float64()), pa.array(prods, pa.float64()), pa.array(starts, pa.float64()), pa.array([False] * n)], [*b.schema.names, "__y", "__a", "__start", "__end"])
        if held is not None:
            ends = pa.array([False] * (held.num_rows - 1) + [True])
            yield held.set_column(held.num_columns - 1, "__end", ends)

    return run


def exponential_mean(df: DataFrame, keys: list[str], order: list[str], column: str, out: str, span: float = 6, keep: list[str] | None = None) -> DataFrame:
    """df with column out: the recursive exponential mean of a key's rows so far, y = (1 - a) y + a x with
    a = 2 / (span + 1), started by the first value. A null leaves it as it is; before the first value it is null.

    Rows are dealt by ranges of keys and order, so a key may lie in many ranges. Each range is gone through once, as
    a pair: what it makes of nothing, and what it leaves of what comes in. The pairs of all ranges, a row for each, are
    chained; then what comes into a range is added to its first key's rows. Memory doesn't grow with a key. Order
    columns should tell a key's rows apart.
    """
    spark, keep = df.sparkSession, [] if keep is None else keep
    cols = df.columns
    r = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(column).cast("double").alias("__x"), *cols)
    by = [f"__k{i}" for i in range(len(keys))] + [F.col(c) for c in order]
    r = r.repartitionByRange(*by).sortWithinPartitions(*by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema)
    t = r.mapInArrow(_scanned(len(keys), 1 - 2 / (span + 1)), f"{kinds}, __y double, __a double, __start double, __end boolean")
    t = written(t.withColumn("__range", F.spark_partition_id()), keep)
    name = F.struct(*[f"__k{i}" for i in range(len(keys))])
    # of each range its first key, that key's first value, and its last row
    firsts = t.where("__a IS NOT NULL").groupBy("__range").agg(F.min(name).alias("first"), F.max("__start").alias("start"))
    ends = t.where("__end").select("__range", name.alias("last"), F.col("__y").alias("y"), F.col("__a").alias("a"))
    carry, before = [], None
    for x in firsts.join(ends, "__range").orderBy("__range").collect():  # a row for each range
        into = before[1] if before and before[0] == x["first"] else None
        carry.append((x["__range"], x["start"] if into is None else into, into is not None))
        y = x["y"] if x["a"] is None else None if carry[-1][1] is None else x["y"] + x["a"] * carry[-1][1]
        before = (x["last"], y)
    t = t.join(F.broadcast(spark.createDataFrame(carry, "__range int, __into double, __carried boolean")), "__range")
    # rows of a range's first key before its first value have one only if it was carried in
    y = F.when(F.col("__a").isNull(), F.col("__y")).when(F.col("__start").isNotNull() | F.col("__carried"), F.col("__y") + F.col("__a") * F.col("__into"))
    return t.select(*cols, y.alias(out))
