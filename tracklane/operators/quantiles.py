"""Exact quantiles of a whole column without bringing it together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a range of values is cut into in a pass, and values of a range that the driver takes.
PARTS, FEW = 1024, 20_000


def quantiles(df: DataFrame, column: str | Column, probs: list[float], by: str | None = None) -> dict:
    """{group: quantiles}, interpolated between neighbours as percentile does, of each value of by (None: of all
    rows, under the key None). Nulls are left out; a group without values has nulls.

    The ranks that a quantile lies between are narrowed down: a pass counts values by the parts of each range that holds
    wanted ranks, and only parts with one go on, until they have few values or a single one. A task counts before the
    shuffle, so a pass moves at most PARTS numbers for each task, group and wanted range; groups should be few.
    """
    c = F.col(column) if isinstance(column, str) else column
    d = df.select((F.lit(None).cast("string") if by is None else F.col(by)).alias("g"), c.cast("double").alias("x"))
    out: dict = {}
    wanted: dict = {}  # (group, rank) -> the value
    todo = []  # group, low, high, values below low, ranks
    for r in d.groupBy("g").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
        out[r["g"]] = r["n"]
        if r["n"]:
            at = {k for p in probs for k in (int(p * (r["n"] - 1)), min(int(p * (r["n"] - 1)) + 1, r["n"] - 1))}
            todo.append((r["g"], r["low"], r["high"], 0, sorted(at)))
    while todo:
        again = []
        for g, low, high, below, ranks in todo:
            if low == high:
                wanted |= {(g, k): low for k in ranks}
            else:
                again.append((g, low, high, below, ranks))
        if not again:
            break
        spans = F.array(*[F.struct(F.lit(g).cast(d.schema["g"].dataType).alias("g"), F.lit(i).alias("i"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (g, low, high, _, _) in enumerate(again)])
        own = F.filter(spans, lambda s: s["g"].eqNullSafe(F.col("g")) & (F.col("x") >= s["low"]) & (F.col("x") <= s["high"]))
        rows = d.where("x IS NOT NULL").select("x", F.explode(own).alias("s"))
        part = F.least(F.floor((F.col("x") - F.col("s.low")) / (F.col("s.high") - F.col("s.low")) * PARTS), F.lit(PARTS - 1)).cast("int")
        counted = rows.groupBy(F.col("s.i").alias("i"), part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        by_span: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["i"], r["part"])):
            by_span.setdefault(r["i"], []).append(r)
        todo, few = [], []
        for i, (g, _, _, below, ranks) in enumerate(again):
            for r in by_span[i]:
                inside = [k for k in ranks if below <= k < below + r["n"]]
                if inside:
                    (few if r["n"] <= FEW else todo).append((g, r["low"], r["high"], below, inside))
                below += r["n"]
        if few:
            near = F.array(*[F.struct(F.lit(g).cast(d.schema["g"].dataType).alias("g"), F.lit(i).alias("i"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (g, low, high, _, _) in enumerate(few)])
            hit = F.filter(near, lambda s: s["g"].eqNullSafe(F.col("g")) & (F.col("x") >= s["low"]) & (F.col("x") <= s["high"]))
            found: dict[int, list] = {}
            for r in d.where("x IS NOT NULL").select("x", F.explode(hit).alias("s")).groupBy("s.i", "x").agg(F.count("*").alias("n")).collect():
                found.setdefault(r["i"], []).append((r["x"], r["n"]))
            for i, (g, _, _, below, ranks) in enumerate(few):
                for x, n in sorted(found[i]):
                    wanted |= {(g, k): x for k in ranks if below <= k < below + n}
                    below += n

    def value(g, n: int, p: float) -> float:
        k, f = int(p * (n - 1)), p * (n - 1) - int(p * (n - 1))
        return wanted[g, k] + (wanted[g, min(k + 1, n - 1)] - wanted[g, k]) * f

    done = {g: [value(g, n, p) if n else None for p in probs] for g, n in out.items()}
    return done or ({None: [None] * len(probs)} if by is None else {})
