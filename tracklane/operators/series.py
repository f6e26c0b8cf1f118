"""Window operators over series of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import tiles


def last_rows(keys: list[str], order: list[str], n: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)


def past(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def ema(column: str, w: WindowSpec, span: int = 6) -> Column:
    """Recursive exponential mean (the first value starts it), of w's whole past."""
    a = 2 / (span + 1)
    return F.aggregate(F.collect_list(column).over(w), F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(s * (1 - a) + x * a))


def filled(column: str, keys: list[str], order: list[str], default: float = 0.0) -> Column:
    """The value, else the last one before, else the first one after, else the default."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(default))


def free_flow(column: str, keys: list[str], enough: int = 4) -> Column:
    w = Window.partitionBy(*keys)
    return F.when(F.count(column).over(w) >= enough, F.percentile(column, F.lit(0.95)).over(w)).otherwise(F.max(column).over(w))


def zscore(column: str, keys: list[str], floor: float = 1e-6) -> Column:
    w = Window.partitionBy(*keys)
    return (F.col(column) - F.avg(column).over(w)) / (F.stddev_samp(column).over(w) + floor)


def guarded_corr(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson correlation; 0 where a series is constant, never NaN, clipped to [-1, 1]."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    r = F.try_divide(over(F.covar_pop(x, y)), over(F.stddev_pop(x)) * over(F.stddev_pop(y)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0))))  # least and greatest skip nulls


def steady_mean(column: str) -> Column:
    """The mean, the same to its last bit in whatever order rows are added up: values of 2^-9 to 2^20 (or 0) are added as
    whole numbers of 2^-20 and the rest of 2^-62, which is exact. Other values, or too many, have avg()'s mean."""
    x = F.col(column).cast("double")
    fits = (x == 0) | F.abs(x).between(2.0**-9, 2.0**20)
    scaled = F.when(fits, x * 2.0**20)
    high = F.floor(scaled)
    low = ((scaled - high) * 2.0**42).cast("long")
    s = (F.try_sum(high) + F.try_sum(low) / 2.0**42) / 2.0**20 / F.count(x)
    return F.when(F.coalesce(F.bool_and(fits), F.lit(False)), F.coalesce(s, F.avg(x))).otherwise(F.avg(x))


def pairs(panel: DataFrame, node: str, time: str, value: str, ordered: bool = True) -> DataFrame:
    """(i, j, time, x, y) of all nodes at the same time; i < j, or both directions."""
    a = panel.select(F.col(node).alias("i"), F.col(time).alias(time), F.col(value).alias("x"))
    b = panel.select(F.col(node).alias("j"), F.col(time).alias(time), F.col(value).alias("y"))
    return a.join(b, time).where("i < j" if ordered else "i <> j")


def met(a: DataFrame, b: DataFrame, by: str, deal: list[str], weight: Column | None = None, band: int = 1024, most: int = 4_000_000) -> DataFrame:
    """Rows of a and b, as a and b, that are equal in by: all pairs of them.

    A group's rows on each side are cut by a hash of deal into bands of about band rows (or of as much weight), and each
    band of a meets each of b by itself, in partitions of about most pairs, so that a large group is no one task's. Rows
    are sent once for each band of their group on the other side.
    """
    weight = F.lit(1) if weight is None else weight
    sizes = a.groupBy(by).agg(F.sum(weight).alias("__m")).join(b.groupBy(by).agg(F.sum(weight).alias("__n")), by)
    n = int(sizes.agg(F.sum(F.col("__m").cast("double") * F.col("__n"))).first()[0] or 0)
    n = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // most))
    bands = sizes.select(by, *[F.ceil(F.col(c) / band).cast("int").alias(c) for c in ("__m", "__n")])

    def side(df: DataFrame, own: str, far: str, bands_own: str, bands_far: str) -> DataFrame:
        cut = df.join(bands, by).withColumn(own, F.pmod(F.xxhash64(*deal), bands_own).cast("int")).withColumn(far, F.explode(F.sequence(F.lit(0), F.col(bands_far) - 1)))
        return cut.select(*df.columns, "__a", "__b").repartition(n, by, "__a", "__b")

    x, y = side(a, "__a", "__b", "__m", "__n").alias("a"), side(b, "__b", "__a", "__n", "__m").alias("b").hint("merge")
    return x.join(y, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.__a") == F.col("b.__a")) & (F.col("a.__b") == F.col("b.__b")))


def paired(df: DataFrame, by: str, key: str, band: int = 1024, most: int = 4_000_000) -> DataFrame:
    """Pairs of rows of df, as a and b, of the same group and a's key below b's; bands of a group as in met()."""
    return met(df, df, by, [key], band=band, most=most).where(F.col(f"a.{key}") < F.col(f"b.{key}"))


def spots(df: DataFrame, node: str, place: list[str], most: int = 256) -> DataFrame:
    """(place, part, nodes): the nodes of each place, a row for each part of about most of them."""
    d = df.where(F.col(node).isNotNull()).select(node, *place)
    size = d.groupBy(*place).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    d = d.join(size, place).withColumn("part", F.pmod(F.xxhash64(node), "parts").cast("int"))
    return d.groupBy(*place, "part").agg(F.collect_list(node).alias("nodes"))


def members(rows: DataFrame, same: Column, values: list[str], names: tuple[str, str] = ("i", "j")) -> DataFrame:
    """(i, j, values), i < j: the pairs of nodes of rows' arrays a.nodes and b.nodes, where each two arrays stand once,
    those that are the same among them."""
    d = rows.select(F.explode("a.nodes").alias("__x"), F.col("b.nodes").alias("__nodes"), same.alias("__same"), *values)
    d = d.select("__x", F.explode("__nodes").alias("__y"), "__same", *values).where(F.when(F.col("__same"), F.col("__x") < F.col("__y")).otherwise(F.col("__x") != F.col("__y")))
    return d.select(F.least("__x", "__y").alias(names[0]), F.greatest("__x", "__y").alias(names[1]), *values)


def block_corr(panel: DataFrame, node: str, time: str, value: str, block: int = tiles.BLOCK) -> DataFrame:
    """(i, j, corr, n) of all pairs i < j of nodes over the times that both have, with guarded_corr's rules. The pairs
    come tile by tile out of products of dense matrices (tiles.over_pairs); none is shuffled or stored."""
    kind = panel.schema[node].dataType.simpleString()
    return tiles.over_pairs(tiles.stored(panel, node, time, value), tiles.listed, f"i {kind}, j {kind}, corr double, n bigint", block)


def block_top(panel: DataFrame, node: str, time: str, value: str, k: int, absolute: bool = False, block: int = tiles.BLOCK) -> DataFrame:
    """(i, j, corr) of block_corr() in both directions, of which each pair of bands keeps a node's k best partners by the
    correlation, or its absolute value, and then the smaller j: enough for any ranking of the first k, and
    k rows for each node and band instead of one for each pair."""
    kind = panel.schema[node].dataType.simpleString()
    return tiles.over_pairs(tiles.stored(panel, node, time, value), tiles.best_partners(k, absolute), f"i {kind}, j {kind}, corr double", block)


def rolling_corr(panel: DataFrame, node: str, time: str, value: str, window: int = 10) -> DataFrame:
    """(i, j, time, corr) of every full window of the last rows of each pair."""
    p = pairs(panel, node, time, value)
    w = Window.partitionBy("i", "j").orderBy(time).rowsBetween(1 - window, 0)
    p = p.withColumn("n", F.count("*").over(w)).withColumn("corr", guarded_corr(F.col("x"), F.col("y"), w))
    return p.where(F.col("n") == window).select("i", "j", time, "corr")


def lagged(series: DataFrame, keys: list[str], step: str, lags: list[int], value: str) -> DataFrame:
    """(keys, step, lag, now, later): each value with the one lag steps later in the same session."""
    a = series.select(*keys, step, F.col(value).alias("now")).withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags])))
    b = series.select(*keys, F.col(step).alias("__to"), F.col(value).alias("later"))
    return a.withColumn("__to", F.col(step) + F.col("lag")).join(b, [*keys, "__to"]).drop("__to")


def ranked(df: DataFrame, by: list, order: list, k: int, name: str = "rnk") -> DataFrame:
    """The first k rows of each group, numbered from 1."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
    return df.withColumn(name, n).where(F.col(name) <= k)


def split_by_position(pos: Column, total: Column, train: float = 0.70, val: float = 0.15) -> Column:
    """Chronological parts with truncated sizes, so 720 rows give 503, 108 and 109."""
    a, b = F.floor(total * F.lit(train)), F.floor(total * F.lit(val))
    return F.when(pos < a, "train").when(pos < a + b, "val").otherwise("test")
