"""Document fingerprints by consistent weighted sampling.

Terms are a document's words and its five-word shingles (the whole sequence where there are fewer words), weighted
by how often they occur. For each sample k a term draws r and c from Gamma(2, 1) and b from U(0, 1), which depend on
the term alone; with weight S, t = floor(ln S / r + b), ln a = ln c - r (t - b + 1), and the term with the least a is
the sample, together with t. Two documents' samples agree with the probability of their generalised Jaccard
similarity. A term's draws come from three tables of variates, indexed by three different parts of its hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, mixed, plain, shingle_values, shuffle_partitions, word_hashes, word_spans

SAMPLES, SHINGLE, ROWS, SEED = 64, 5, 1 << 12, 20_000


def _tables() -> tuple[np.ndarray, ...]:
    kept = np.__dict__.setdefault("_cws_tables", {})
    if SEED not in kept:
        g = np.random.Generator(np.random.PCG64(SEED))
        r = g.gamma(2.0, 1.0, (ROWS, SAMPLES)).astype(np.float32)
        c = np.log(g.gamma(2.0, 1.0, (ROWS, SAMPLES))).astype(np.float32)
        b = g.random((ROWS, SAMPLES), np.float32)
        kept[SEED] = (np.maximum(r, np.float32(1e-4)), c, b, 1 - b)
    return kept[SEED]


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms, ascending, and their weights."""
    data = LOWER_BYTES[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    w = word_hashes(data, *word_spans(data)) if len(data) else np.zeros(0, np.uint64)
    return np.unique(np.concatenate((w, shingle_values(text, SHINGLE))), return_counts=True)


def signature(text: str | None) -> np.ndarray:
    """SAMPLES values of 32 bits; all zero for a text without words."""
    h, n = terms(text)
    if not len(h):
        return np.zeros(SAMPLES, np.uint32)
    R, C, B, rest = _tables()
    best, pick, level = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.float32)
    columns = np.arange(SAMPLES)
    mask = np.uint64(ROWS - 1)
    for at in range(0, len(h), 2048):  # bounded memory for long texts
        part = h[at : at + 2048]
        x, y, z = (((part >> np.uint64(k)) & mask).astype(np.int64) for k in (0, 20, 40))
        a = R[x]
        a *= rest[z]
        np.subtract(C[y], a, out=a)  # ln a where the weight is one and so t is 0
        many = np.flatnonzero(n[at : at + 2048] > 1)
        r, ln = R[x[many]], np.log(n[at + many].astype(np.float32))[:, None]
        t = np.floor(ln / r + B[z[many]])
        a[many] -= r * t
        i = a.argmin(0)
        low = a[i, columns]
        better = low < best
        best[better], pick[better], level[better] = low[better], at + i[better], 0
        if len(many):
            of = np.full(len(part), -1)
            of[many] = np.arange(len(many))
            of = of[i]
            use = better & (of >= 0)
            level[use] = t[of[use], columns[use]]
    with np.errstate(over="ignore"):
        return (mixed(h[pick] + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples that agree; 1 for two texts without words, 0 if one has none."""
    return float((a == b).mean())


def hexed(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def fingerprinted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, fingerprint): the samples as hexadecimal digits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b.iloc[:, 0], "fingerprint": [hexed(signature(t)) for t in b.iloc[:, 1]]})

    d = plain(docs, key, text)
    return d.mapInPandas(run, f"{key} {d.schema[key].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def edit_study(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of all texts and of their edited forms (the last third of the characters replaced by the first as
    many of the next document, by descending key; after the last one comes the first), a row per document.

    Texts are shuffled once: rows go to ranges of key and text hash, sorted within; the first row of each range also
    goes to the range before it, as the next of its last row. Keys may be of any type with an order. Null keys come
    last; rows of one key follow by their text's hash; a single document is its own next; an empty table gives no rows.
    """
    spark = docs.sparkSession
    d = plain(docs, key, text).toDF("key", "text").select("key", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind, ranges = d.schema["key"].dataType.simpleString(), 4 * shuffle_partitions(spark)
    # about 50 rows a range, by hash, show where to cut
    of = max(1, d.count() // (50 * ranges))
    seen = d.where(F.pmod(F.xxhash64("key", "h"), F.lit(of)) == 0).select("key", "h").distinct().orderBy(F.desc_nulls_last("key"), "h").collect()
    cuts = [seen[i] for i in sorted({len(seen) * i // ranges for i in range(1, ranges)} - {0}) if i < len(seen)]
    bounds = F.array(*[F.struct(F.lit(c["key"]).cast(kind).alias("key"), F.lit(c["h"]).alias("h")) for c in cuts]).cast(f"array<struct<key:{kind},h:bigint>>")

    def passed(cut):
        earlier = F.coalesce(cut["key"] > F.col("key"), cut["key"].isNotNull() & F.col("key").isNull())
        return earlier | (cut["key"].eqNullSafe(F.col("key")) & (cut["h"] <= F.col("h")))

    d = d.select("key", "text", F.size(F.filter(bounds, passed)).alias("range"), "h")
    # the first of a range: the largest key, nulls last, and then the least hash
    firsts = d.groupBy("range").agg(F.max(F.struct("key", F.bitwise_not("h").alias("h"))).alias("x")).orderBy("range").collect()  # a row for each range
    before = {r["range"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    guest = F.lit(None).cast("int")
    if firsts:
        rows = spark.createDataFrame([(r["range"], r["x"]["key"], ~r["x"]["h"], before[r["range"]]) for r in firsts], f"r int, k {kind}, hh long, guest int")
        d = d.join(F.broadcast(rows), (d["range"] == rows.r) & d["key"].eqNullSafe(rows.k) & (d["h"] == rows.hh), "left")
        guest = F.col("guest")
    d = d.select("key", "text", "h", F.explode(F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("visits")), F.when(guest.isNotNull(), F.struct(guest.alias("range"), F.lit(True).alias("visits")))))).alias("x"))
    d = d.select("key", "text", "h", "x.*").repartition(ranges, "range").sortWithinPartitions("range", "visits", F.desc_nulls_last("key"), "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before: key, text, signature, range
        ended = None  # the range whose guest has been used

        def row(key, text, sig, following, next_sig):
            e = edited(text, following)
            s = signature(e) if e != text else sig
            digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
            return key, len(text), digest, hexed(sig), hexed(s), likeness(sig, s), likeness(sig, next_sig)

        for b in batches:
            out = []
            for k, t, g, visits in zip(b["key"], b["text"], b["range"], b["visits"], strict=True):
                if visits and ended == g:
                    continue
                s = held[2] if held and held[1] == t else signature(t)
                if held and held[3] == g:
                    out.append(row(*held[:3], t, s))
                if visits:
                    ended, held = g, None
                else:
                    held = (k, t, s, g)
            r = pd.DataFrame(out, columns=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield r.astype({"key": b["key"].dtype} if len(r) and not r["key"].isna().any() else {})

    out = d.select("key", "text", "range", "visits").mapInPandas(run, f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("key", key)
