"""Validation and cleaning of observations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def errors(checks: dict[str, Column]) -> tuple[Column, Column]:
    """is_valid and the messages of the checks that fail (a null check fails)."""
    e = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), m) for m, c in checks.items()]))
    return F.size(e) == 0, e


def within(c: Column, low: float, high: float | None = None) -> Column:
    """Null passes."""
    return c.isNull() | (c.between(low, high) if high is not None else c >= low)


def valid_segment(distance: Column, shape: Column, results: Column, most: float = 10_000) -> dict[str, Column]:
    return {
        "distance": (distance > 0) & (distance <= most),
        "shape": F.size(shape) >= 2,
        "points": F.forall(shape, lambda p: p["latitude"].between(-90, 90) & p["longitude"].between(-180, 180)),
        "results": F.size(results) > 0,
    }


def null_ratios(df: DataFrame, columns: list[str], limit: float = 0.2) -> DataFrame:
    """Rows (column, nulls, ratio, too_many) from one pass."""
    n = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    n = n.selectExpr("n", f"stack({len(columns)}, {pairs}) as (column, nulls)")
    share = F.coalesce(F.try_divide("nulls", "n"), F.lit(0.0))
    return n.select("column", "nulls", share.alias("ratio"), (share > limit).alias("too_many"))


def drop_invalid(df: DataFrame, speeds: list[str], sample: str, least: int = 10) -> DataFrame:
    ok = [F.col(c).isNull() | (F.col(c) > 0) for c in speeds] + [F.col(sample).isNull() | (F.col(sample) >= least)]
    return df.where(reduce(and_, ok))


def to_kilometres(df: DataFrame, column: str, limit: float = 50) -> DataFrame:
    """Divide by 1000 where the median of the whole column is over the limit."""
    m = quantiles(df, column, [0.5])[None][0]
    return df.withColumn(column, F.col(column) / 1000) if m is not None and m > limit else df


def interpolate(df: DataFrame, keys: list[str], order: list[str], column: str, limit: int | None = 3) -> DataFrame:
    """Linear by position between neighbours, flat outside them, only within limit rows of one (None: anywhere); what
    is left gets the median of its group, then that of all rows. Order columns must be unique within a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("__i", F.row_number().over(w))
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(column).alias("x")))
    before = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("__a", before).withColumn("__b", after)
    a, b, i = F.col("__a"), F.col("__b"), F.col("__i")
    line = F.when(a.isNull(), b["x"]).when(b.isNull() | (a["i"] == b["i"]), a["x"]).otherwise(a["x"] + (b["x"] - a["x"]) * (i - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0)))
    near = F.lit(True) if limit is None else F.coalesce((i - a["i"]) <= limit, F.lit(False)) | F.coalesce((b["i"] - i) <= limit, F.lit(False))
    df = df.withColumn("__x", F.coalesce(F.col(column), F.when(near, line)))
    df = df.withColumn("__x", F.coalesce("__x", F.median("__x").over(Window.partitionBy(*keys))))
    every = F.lit(quantiles(df, "__x", [0.5])[None][0]).cast("double")
    return df.withColumn(column, F.coalesce("__x", every)).drop("__i", "__a", "__b", "__x")


def iqr_cap(df: DataFrame, keys: list[str], column: str, k: float = 1.5, least: float = 1.0) -> DataFrame:
    """Cap at k interquartile ranges outside a group's quartiles; groups with a range under least use all rows' ones."""
    q = lambda p, *by: F.percentile(column, F.lit(p))
    own = df.groupBy(*keys).agg(q(0.25).alias("__1"), q(0.75).alias("__3"))
    g1, g3 = (F.lit(x).cast("double") for x in quantiles(df, column, [0.25, 0.75])[None])
    df = df.join(own, keys)
    wide = F.col("__3") - F.col("__1") >= least
    low, high = F.when(wide, F.col("__1")).otherwise(g1), F.when(wide, F.col("__3")).otherwise(g3)
    x = F.col(column)
    capped = F.when(x.isNotNull(), F.greatest(low - k * (high - low), F.least(high + k * (high - low), x)))
    return df.withColumn(column, capped).drop("__1", "__3")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
