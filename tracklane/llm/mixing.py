"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Targets share the total by weight and stop at a multiple of their source's size. A source's complete epochs come
first; what is left is filled by its documents in ascending order of the exponential key -ln(u) / w, u a hash of the
document's key and w its quality weight. The prefix sum is taken in two steps, so that no source meets in one task:
keys are cut at quantiles over all documents, sizes are summed by source and cut, and only the one cut in which a
source's budget ends is sorted. The decision of a document then needs one row of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, written

WEIGHTS, CAP, CUTS, SIGNS = (5, 2, 1), 3, 1024, "!#$%&*|"
#: Rows of a source that are sorted in one task; a cut with more is cut again.
SORTED = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less the more of its characters are signs that junk consists of. Signs stand for quality
    here because one native expression and its SQL twin can count them; any other column of weights over 0, a
    classifier's score for one, goes in as the parameter quality."""
    n = F.coalesce(F.length(text), F.lit(0))
    signs = n - F.coalesce(F.length(F.translate(text, SIGNS, "")), F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * signs / F.greatest(n, F.lit(1)))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of the md5 of the key as text."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Rows (source, source_size) with a target. Sources in order of code points, null last, weigh in turn.

    The water level: sources in order of cap / weight fill up until the rest fits below the next one's.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    t = sources.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("most") / F.col("weight"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    t = t.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return t.withColumn("found", found).select("source", "source_size", F.least("most", F.coalesce(F.col("found") * F.col("weight"), F.col("most"))).alias("target"))


def _sort_key(docs: DataFrame, text: str, key: str, quality: Column | None) -> Column:
    return -F.log(uniform(docs[key])) / (quality_weight(docs[text]) if quality is None else F.greatest(quality.cast("double"), F.lit(1e-9)))


def _tie(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def _cut(at: Column, cuts: list[float]) -> Column:
    """How many cuts (ascending) lie below: first in steps of 32, then one by one."""
    if not cuts:
        return F.lit(0)
    coarse = F.size(F.filter(F.array(*map(F.lit, cuts[31::32])), lambda c: c < at)) if len(cuts) > 31 else F.lit(0)
    return coarse * 32 + F.size(F.filter(F.slice(F.array(*map(F.lit, cuts)), coarse * 32 + 1, 31), lambda c: c < at))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, text: str = "text", key: str = "doc_id", source: str = "source", quality: Column | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (key, source, size, at, tie) as a table, and a row for each source: source_size, target, epochs, and
    where its fractional part ends: documents below (last_at, last_tie) are in it, and of the last_all ones equal to
    both, which repeat one row, the first last_n. Without a fractional part last_at is -1. keep takes the tables' paths."""
    keep, old = [] if keep is None else keep, []
    s = written(docs.select(docs[key].alias("key"), docs[source].alias("source"), words(docs[text]).alias("size"), _sort_key(docs, text, key, quality).alias("at"), _tie(docs[text]).alias("tie")), keep)
    cuts = sorted(set(s.select(F.percentile_approx("at", [i / CUTS for i in range(1, CUTS)], 10 * CUTS)).first()[0] or []))
    rows = s.withColumn("cut", _cut(F.col("at"), cuts).cast("int"))
    by_cut = written(rows.groupBy("source", "cut").agg(F.sum("size").alias("sum"), F.count("*").alias("n")), old)
    t = targets(by_cut.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, cap)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = written(t.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), old)
    ends = written(_ending(by_cut.join(t.select(F.col("source").alias("of"), "budget", F.lit(0).cast("long").alias("below")), F.col("source").eqNullSafe(F.col("of"))).drop("of")), old)
    while True:
        inside = rows.join(ends.select(F.col("source").alias("of"), F.col("cut").alias("last_cut"), "below", "budget"), F.col("source").eqNullSafe(F.col("of")) & (F.col("cut") == F.col("last_cut"))).drop("of", "last_cut", "cut")
        if (ends.agg(F.max("n")).first()[0] or 0) <= SORTED:
            break
        # too many rows for one sort: the same again within each source's cut, by (at, tie)
        inside = written(inside, old)
        order = F.struct("at", "tie")
        few = inside.groupBy("source").agg(F.percentile_approx("at", [i / 256 for i in range(1, 256)], 2560).alias("marks"), F.min(order).alias("low"), F.max(order).alias("high"))
        if few.where("low < high").isEmpty():
            break
        few = few.select(F.col("source").alias("of"), "marks")
        # equal keys, as of rows without one, are divided by their ties
        cut = F.size(F.filter("marks", lambda m: m < F.col("at"))) * 256 + F.when(F.exists("marks", lambda m: m == F.col("at")), F.floor(F.col("tie") / float(1 << 56)) + 128).otherwise(0)
        rows = written(inside.join(few, F.col("source").eqNullSafe(F.col("of"))).select("key", "source", "size", "at", "tie", cut.cast("int").alias("cut"), "below", "budget"), old)
        sums = rows.groupBy("source", "cut", "below", "budget").agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        before = ends.agg(F.max("n")).first()[0]
        ends = written(_ending(sums), old)
        rows = rows.drop("below", "budget")
        if (ends.agg(F.max("n")).first()[0] or 0) >= before:
            inside = rows.join(ends.select(F.col("source").alias("of"), F.col("cut").alias("last_cut"), "below", "budget"), F.col("source").eqNullSafe(F.col("of")) & (F.col("cut") == F.col("last_cut"))).drop("of", "last_cut", "cut")
            break
    # equal rows are one entry with a count
    groups = inside.groupBy("source", "at", "tie", "size", "below", "budget").agg(F.count("*").alias("n"))
    before = F.col("below") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("at", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row is in if its end is within the budget, or else if that is nearer than its start
    left = F.col("budget") - before
    fits = F.when(F.col("size") == 0, F.when(left >= 0, F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.greatest(F.lit(0), F.floor(left / F.col("size") + 0.5)))).cast("long")
    last = groups.withColumn("taken", fits).groupBy("source").agg(F.max(F.when(F.col("taken") > 0, F.struct("at", "tie", "taken", "n"))).alias("x"), F.min(F.struct("at", "tie")).alias("first"))
    last = last.select(F.col("source").alias("of"), "x", "first")
    t = t.join(last, F.col("source").eqNullSafe(F.col("of")), "left")
    # nothing of the cut is in: all before its first row are
    at = F.when(F.col("x").isNotNull(), F.col("x.at")).when(F.col("first").isNotNull(), F.col("first.at")).otherwise(-1.0)
    tie = F.when(F.col("x").isNotNull(), F.col("x.tie")).when(F.col("first").isNotNull(), F.col("first.tie")).otherwise(F.lit(0)).cast("long")
    t = written(t.select("source", "source_size", "target", "epochs", at.alias("last_at"), tie.alias("last_tie"), F.coalesce("x.taken", F.lit(0)).cast("long").alias("last_n"), F.coalesce("x.n", F.lit(0)).cast("long").alias("last_all")), keep)
    dropped(docs.sparkSession, old)
    return s, t


def _ending(sums: DataFrame) -> DataFrame:
    """Of each source's cuts (source, cut, sum, n, below, budget), the one in which its budget ends, with what lies
    below it. Sources without a budget have none."""
    upto = F.col("below") + F.sum("sum").over(Window.partitionBy("source").orderBy("cut"))
    c = sums.withColumn("upto", upto).withColumn("under", F.col("upto") - F.col("sum"))
    return c.where((F.col("budget") > 0) & (F.col("under") < F.col("budget")) & (F.col("upto") >= F.col("budget"))).select("source", "cut", "n", F.col("under").alias("below"), "budget")


def _numbered(equal: DataFrame) -> DataFrame:
    """Rows with a column number: their position from 1 among those of one source, without bringing them together:
    positions within each partition are moved up by the counts of the partitions before."""
    part = equal.withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id())
    part = part.withColumn("number", F.row_number().over(Window.partitionBy("src", "part").orderBy("id")))
    counts = part.groupBy("src", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.select(F.col("src").alias("src2"), F.col("part").alias("part2"), "start")
    part = part.join(counts, F.col("src").eqNullSafe(F.col("src2")) & (F.col("part") == F.col("part2")))
    return part.withColumn("number", F.col("number") + F.col("start")).drop("part", "id", "src2", "part2", "start")


def _copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (row, src, at, tie) with copies, the times that the mix has a row. Only rows equal to the last one of
    their source are numbered, and only where not all of them are in."""
    x = rows.join(sources.withColumnRenamed("source", "of"), F.col("src").eqNullSafe(F.col("of"))).drop("of")
    equal = (F.col("at") == F.col("last_at")) & (F.col("tie") == F.col("last_tie"))
    under = (F.col("at") < F.col("last_at")) | ((F.col("at") == F.col("last_at")) & (F.col("tie") < F.col("last_tie")))
    if sources.where("last_n < last_all").isEmpty():
        return x.withColumn("copies", F.col("epochs") + (under | (equal & (F.col("last_n") > 0))).cast("long"))
    rest = x.where(~equal).withColumn("copies", F.col("epochs") + under.cast("long"))
    last = _numbered(x.where(equal)).withColumn("copies", F.col("epochs") + (F.col("number") <= F.col("last_n")).cast("long")).drop("number")
    return rest.unionByName(last)


def shares(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, text: str = "text", key: str = "doc_id", source: str = "source", quality: Column | None = None) -> DataFrame:
    """Rows (key, size, source_size, target, taken), one per row of docs.

    Null texts have size 0; null sources are a source of their own; null keys share one u and are ordered by their
    texts' hashes; of repeated rows as many are taken as the target asks for; a source at its cap, or the only one,
    has complete epochs alone; an empty table gives no rows. Reruns agree.
    """
    s, t = plan(docs, weights, cap, text, key, source, quality)
    x = _copies(s.select("key", F.col("source").alias("src"), "size", "at", "tie"), t)
    return x.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, text: str = "text", key: str = "doc_id", source: str = "source", quality: Column | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names. Odd
    rows are handled as in shares(). Texts aren't shuffled where the table of sources is small enough for Spark to
    broadcast it."""
    old: list[str] = []
    _, t = plan(docs, weights, cap, text, key, source, quality, old)
    dropped(docs.sparkSession, old[:1])  # the keyed documents
    x = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source].alias("src"), _sort_key(docs, text, key, quality).alias("at"), _tie(docs[text]).alias("tie"))
    x = _copies(x, t).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return x.select("row.*")
