"""SimHash near-duplicates by multi-index hashing.

Contract of the query: words of the ASCII-lower-cased text, three-word shingles with repeats, XXH64 (seed 42) of
each, majority bits; fingerprints link at two or fewer differing bits; components of links.

Multi-index hashing. A fingerprint is cut into three segments of 21, 21 and 22 bits, each with a table from its value to
fingerprints. Two differing bits lie in two segments at most, so of the three segments of fingerprints within two bits
one is equal: a lookup of the own values in each table brings all such pairs together, three rows for each fingerprint,
and matches are verified by the complete distance. Values with very many members are divided further (candidates()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, plain, words_of, written

SEED, SEGMENTS, HOT = 42, 3, 256


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of the space-joined shingles; of the whole sequence if there are fewer words; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = memoryview(b" ".join(words)), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, n)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """Rows (key, fp): fp the 64 bits as a long. Null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = [majority(shingle_hashes(words_of(t), shingle)) for t in b.iloc[:, 1]]
            yield pd.DataFrame({key: b.iloc[:, 0], "fp": np.array(fps, np.uint64).view(np.int64)})

    d = plain(docs, key, text)
    return d.mapInPandas(run, f"{key} {d.schema[key].dataType.simpleString()}, fp long")


def _bits(x: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << high - low) - 1).cast("long"))


def _edges(width: int) -> list[tuple[int, int]]:
    """The first bit of each segment of width bits, and the bit after its last."""
    return [(i * width // SEGMENTS, (i + 1) * width // SEGMENTS) for i in range(SEGMENTS)]


def candidates(fps: DataFrame, column: str = "fp", hot: int = HOT) -> DataFrame:
    """Pairs (a, b), b < a, of fingerprints that a table lookup brings together: equal in one segment.

    A segment value with over hot members is divided by segments of the other bits, of which one is equal too, since two
    bits differ at most in all. So no pair within two bits is lost at any size.

    Tables are merged with themselves: Spark takes an exploded table for as small as what it is exploded from, and would
    send it to all tasks through the driver.
    """
    x, keys = fps.select(F.col(column).alias("fp")).distinct(), ["segment", "value"]
    tables, rests = [], []
    for s, (low, high) in enumerate(_edges(64)):
        tables.append(x.select(F.lit(s).alias("segment"), _bits(F.col("fp"), low, high).alias("value"), "fp"))
        rest = F.shiftleft(_bits(F.col("fp"), high, 64), low).bitwiseOR(_bits(F.col("fp"), 0, low))
        rests.append(F.array(*[F.struct(F.lit(j).alias("j"), _bits(rest, *e).alias("v")) for j, e in enumerate(_edges(64 - high + low))]))
    table = tables[0].unionAll(tables[1]).unionAll(tables[2])
    large = table.groupBy(*keys).agg(F.count("*").alias("members")).where(F.col("members") > hot).select(*keys)
    pair = lambda t, on: t.withColumnRenamed("fp", "b").join(t.withColumnRenamed("fp", "a").hint("merge"), on).where("b < a").select("a", "b")
    few = pair(table.join(large, keys, "left_anti"), keys)
    divided = table.join(large, keys).select(*keys, "fp", F.explode(F.array(*rests)[F.col("segment")]).alias("sub"))
    return few.unionAll(pair(divided, [*keys, "sub"]))


def links(fps: DataFrame, column: str = "fp", radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints within radius (two at most) bits, by their complete distance."""
    c = candidates(fps, column).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return c.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """Rows (key, fingerprint, component_id), one per row of docs.

    component_id is the smallest key reachable over links, itself included. Null text counts as empty; rows
    without words share fingerprint zero and link like any other; repeated rows each get a row; null keys are kept
    and never become a component's id unless it has no other (then it is null); an empty table gives none.
    """
    old: list[str] = []
    fps = written(fingerprints(docs, text, key, shingle))
    distinct = written(fps.groupBy("fp").agg(F.min(key).alias("least")), old)
    roots = components(links(distinct), old)
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, old)
    by_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = written(joined.join(by_root, "root").select("fp", "component_id"))
    dropped(docs.sparkSession, old)
    return fps.join(of_fp, "fp", "left").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates (jaccard.duplicates): the one with the smallest key; of
    several rows with that key, one of the text with the least hash. Columns are those of docs, whatever their names;
    texts without words are one group; groups of null keys alone keep one row; an empty table gives no rows."""
    from . import jaccard

    groups = jaccard.duplicates(docs, text, key, shingle, least)
    best = groups.where(F.col("key").eqNullSafe(F.col("group")))
    # a key may have several texts in one group
    best = best.groupBy("key", "group").agg(F.min_by(F.struct("h", "n_rows"), F.struct(F.col("h").isNull(), F.col("h"))).alias("x"))
    best = best.select(F.col("key").alias("k2"), F.col("x.h").alias("h2"), F.col("x.n_rows").alias("n"))
    d = docs.select(docs[key].alias("k"), F.xxhash64(docs[text]).alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    d = d.join(best, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")))
    return d.where("n = 1").select("row.*").unionAll(d.where("n > 1").dropDuplicates(["k", "h"]).select("row.*"))
