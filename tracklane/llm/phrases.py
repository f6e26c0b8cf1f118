"""Phrase collocations: n-grams of frequent words as fixed-width keys, counted by one range-partitioned sort.

Words that occur often enough in their language get ids; pieces break at all others. From each word on, the ids of up to
four words of its piece are packed into one key of 128 bits (two longs, 32 bits a word, zero where the piece has ended).
Keys are sorted and run-length counted in each task first, then dealt out by key range, sorted (Spark's radix sort of
8-byte prefixes) and run-length counted again: the runs of the first two, three and four words are the counts of all
phrases. Runs at the edge of a range are added up with those of the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, dropped, mixed, shuffle_partitions, word_hashes, word_spans, written

#: Words of the dictionary that tasks hold (8 bytes each); a larger one is joined to the words of the texts instead.
WORDS = 1 << 22
#: Bytes of text worked on at once; a longer text is hashed in parts.
BLOCK = 1 << 20
#: Keys that a task sorts at once.
KEYS = 1 << 20
#: Keys, about, of a sample of documents that ranges are cut by; they decide how even ranges are, not what is counted.
SAMPLE = 200_000
#: Words that meet in a group where the dictionary is joined.
JOINED = 4096
#: Parts of a language in the first of two rounds of the final ranking.
PARTS = 64
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True


def _bases() -> Iterator[int]:
    x = 0x9E3779B97F4A7C15
    while True:
        yield x | 1
        x = x * 0xD1342543DE82EF95 % (1 << 64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts, some BLOCK bytes at a time."""
    langs: list[str] = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for i in range(0, b.num_rows, 64):
            some = b.slice(i, 64)
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    langs.append("und" if lang is None else lang)
                    texts.append(text)
                    size += len(text) + 1
                    if size >= BLOCK:
                        yield langs, texts
                        langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def _hashed(langs: list[str], texts: list[bytes], base: int):
    """The lower-cased bytes, starts and ends of their words, each word's hash with its language, whether a piece
    begins with it, and the number of its language among names."""
    data = LOWER_BYTES[np.frombuffer(b"\n".join(texts), np.uint8)]
    ends_here = ENDS[data]
    starts, ends = word_spans(np.where(ends_here, 32, data).astype(np.uint8))
    names = sorted(set(langs))
    own = np.array([int.from_bytes(n.encode("utf-8", "surrogatepass"), "little") * base % ((1 << 61) - 1) for n in names], np.uint64)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    lang = np.searchsorted(names, langs)[np.searchsorted(bounds, starts, "right")] if len(starts) else np.zeros(0, int)
    parts, i = [], 0
    while i < len(starts):  # word hashes take many bytes for each byte of text
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        parts.append(word_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i], base))
        i = j
    key = mixed(np.concatenate(parts) ^ mixed(own)[lang]) if parts else np.zeros(0, np.uint64)
    passed = np.cumsum(ends_here)
    first = np.diff(passed[starts], prepend=-1) != 0 if len(starts) else np.zeros(0, bool)
    return data, starts, ends, key.view(np.int64), first, lang, names


def _counter(base: int) -> Callable:
    """Tasks' counts of words: k, lang, word, n; with a null word, of all words of a language."""

    def merged(rows: list[tuple]) -> pa.RecordBatch:
        k, n = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        u, at, inverse = np.unique(k, return_index=True, return_inverse=True)
        langs, words = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
        return u, np.bincount(inverse, n, len(u)).astype(np.int64), langs[at], words[at]

    def out(u, n, langs, words) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n)], ["k", "lang", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, totals = [], 0, {}
        for langs, texts in _texts(batches):
            data, starts, ends, key, _, lang, names = _hashed(langs, texts, base)
            u, at, n = np.unique(key, return_index=True, return_counts=True)
            raw = data.tobytes()
            words = np.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)] + [None], object)[:-1]
            rows.append((u, n, np.array(names, object)[lang[at]], words))
            held += len(u)
            for name, c in zip(names, np.bincount(lang, minlength=len(names)).tolist(), strict=True):
                totals[name] = totals.get(name, 0) + c
            if held > 300_000:
                rows = [merged(rows)]
                if len(rows[0][0]) > 150_000:
                    yield out(*rows[0])
                    rows = []
                held = len(rows[0][0]) if rows else 0
        if rows:
            yield out(*merged(rows))
        if totals:
            yield out(np.zeros(len(totals), np.int64), np.array(list(totals.values()), np.int64), list(totals), [None] * len(totals))

    return count


def _keys(ids: np.ndarray, first: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the words (the first own ones) that another follows in their piece."""
    a, after = ids.astype(np.int64), [np.zeros(0, np.int64)] * 3
    alive = a > 0
    for k in (1, 2, 3):
        nxt = np.zeros(len(a), np.int64)
        if len(a) > k:
            alive = alive[: len(a) - k] & ~first[k:] & (a[k:] > 0)
            nxt[: len(a) - k] = np.where(alive, a[k:], 0)
        else:
            alive = np.zeros(0, bool)
        after[k - 1] = nxt
    keep = np.flatnonzero(after[0][:own] > 0)
    return a[keep] << 32 | after[0][keep], after[1][keep] << 32 | after[2][keep]


def _counted(hi: np.ndarray, lo: np.ndarray, cuts: list[tuple[int, int]]) -> pa.RecordBatch:
    """Distinct keys, sorted, with their counts and ranges."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    n = np.diff(np.append(new, len(hi)))
    hi, lo = hi[new], lo[new]
    part = np.zeros(len(hi), np.int32)
    for h, low in cuts:
        i, j = np.searchsorted(hi, [h, h + 1])
        i += np.searchsorted(lo[i:j], low)
        if i < len(part):
            part[i] += 1
    return pa.RecordBatch.from_arrays([pa.array(np.cumsum(part, dtype=np.int32)), pa.array(hi), pa.array(lo), pa.array(n.astype(np.int64))], ["part", "hi", "lo", "n"])


def _collected(found: Iterator[tuple[np.ndarray, np.ndarray]], cuts: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pair in found:
        held.append(pair)
        size += len(pair[0])
        if size >= KEYS:
            yield _counted(np.concatenate([h for h, _ in held]), np.concatenate([x for _, x in held]), cuts)
            held, size = [], 0
    if size:
        yield _counted(np.concatenate([h for h, _ in held]), np.concatenate([x for _, x in held]), cuts)


PACKED = "part int, hi long, lo long, n long"


def _runs(least: int) -> Callable:
    """Runs of the first two, three and four words in sorted keys; a run at either edge of the range is given
    whatever its length."""
    low = np.int64(0xFFFFFFFF)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # of each size the run that may go on: hi, lo, n, whether it is the range's first

        def out(size: int, hi, lo, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), size, np.int32)), pa.array(hi), pa.array(lo), pa.array(n)], ["size", "hi", "lo", "n"])

        for b in batches:
            hi, lo, n = (b.column(i).to_numpy() for i in range(3))
            for size, keep, cut in ((2, slice(None), lo & 0), (3, lo > 0, lo & ~low), (4, (lo & low) > 0, lo)):
                h, x, c = hi[keep], cut[keep], n[keep]
                if not len(h):
                    continue
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (x[1:] != x[:-1]))))
                h, x, c = h[new], x[new], np.add.reduceat(c, new)
                started = size not in held
                if not started and held[size][:2] == [h[0], x[0]]:
                    c[0] += held[size][2]
                    started = held[size][3]
                elif not started:
                    if held[size][2] >= least or held[size][3]:
                        yield out(size, *(np.array([v], np.int64) for v in held[size][:3]))
                edge = np.zeros(len(h), bool)
                edge[0] = started
                held[size] = [h[-1], x[-1], c[-1], bool(edge[-1])]
                full = np.flatnonzero((c >= least) | edge)
                full = full[full < len(h) - 1]
                if len(full):
                    yield out(size, h[full], x[full], c[full])
        for size, run in held.items():
            yield out(size, *(np.array([v], np.int64) for v in run[:3]))

    return count


def _numbered(words: DataFrame, keep: list[str]) -> DataFrame:
    """words with id: their rank, from 1, in the order of k."""
    s = words.repartitionByRange(shuffle_partitions(words.sparkSession), "k").sortWithinPartitions("k")
    s = written(s.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), keep)
    sizes = s.groupBy("part").agg(F.count("*").alias("size"))
    ahead = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("ahead"))  # a row for each partition
    return s.join(F.broadcast(ahead), "part").withColumn("id", F.col("ahead") + F.col("at") + 1).drop("part", "at", "ahead")


def _packed(docs: DataFrame, words: DataFrame, many: int, total: int, base: int) -> DataFrame:
    """Keys with their counts by task, and the range that each belongs to."""
    spark = docs.sparkSession
    if many <= WORDS:
        shared = spark.sparkContext.broadcast(np.sort(words.select("k").toArrow().column(0).to_numpy()))

        def found(batches):
            known = shared.value
            for langs, texts in _texts(batches):
                _, _, _, key, first, _, _ = _hashed(langs, texts, base)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                yield _keys(np.where(known[at] == key, at + 1, 0), first)

        def keys(some: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
            return some.mapInArrow(lambda batches: _collected(found(batches), cuts), PACKED)
    else:

        def spread(batches):
            task, n = TaskContext.get().partitionId(), 0
            for langs, texts in _texts(batches):
                _, _, _, key, first, _, _ = _hashed(langs, texts, base)
                for i in range(0, len(key), JOINED):
                    k = key[i : i + JOINED + 3]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), task << 32 | n)), pa.array(np.arange(len(k), dtype=np.int32)), pa.array(first[i : i + JOINED + 3]), pa.array(k)], ["block", "at", "first", "k"])
                    n += 1

        def found_again(batches):
            for b in batches:
                for x in b.column(0).to_pylist():
                    yield _keys(np.array([w["id"] or 0 for w in x], np.int64), np.array([w["first"] for w in x], bool), JOINED)

        def keys(some: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
            w = some.mapInArrow(spread, "block long, at int, first boolean, k long").join(words.select("k", "id"), "k", "left")
            blocks = w.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "first", "id"))).alias("w")).select("w")
            return blocks.mapInArrow(lambda batches: _collected(found_again(batches), cuts), PACKED)

    parts = shuffle_partitions(spark)
    # a sample of documents says where ranges of like many keys begin
    some = keys(docs.sample(min(1.0, SAMPLE / max(total, 1)), 7), []).select("hi", "lo").toArrow().to_pandas().sort_values(["hi", "lo"])
    cuts = [tuple(some.iloc[len(some) * i // parts].tolist()) for i in range(1, parts)] if len(some) else []
    return keys(docs, sorted(set(cuts))).repartitionById(parts, "part").sortWithinPartitions("hi", "lo").select("hi", "lo", "n")


def _ids() -> list[Column]:
    low = F.lit(0xFFFFFFFF)
    return [F.shiftright("hi", 32), F.col("hi").bitwiseAND(low), F.shiftright("lo", 32), F.col("lo").bitwiseAND(low)]


def _key(ids: list[Column]) -> Column:
    w = [*ids, *[F.lit(0).cast("long")] * (4 - len(ids))]
    return F.struct(F.shiftleft(w[0], 32).bitwiseOR(w[1]).alias("hi"), F.shiftleft(w[2], 32).bitwiseOR(w[3]).alias("lo"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, within: int = 80, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The first top phrases of two to four words of each language, by how much more often they occur than their parts:
    rows lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its weakest cut, n all words of the language; the score is
    floor(2000000 * a / (l + r)), computed in decimals. Phrases with a < least aren't counted, and those inside a
    longer one that occurs within percent as often or more are dropped. Null texts are empty; null languages are
    "und"; repeated rows count each time; a language without such phrases, or an empty table, gives no rows; texts of
    any length are worked on in parts; extra columns are not read. keep takes the paths of the tables that the result reads.
    """
    spark, old = docs.sparkSession, []
    keep = [] if keep is None else keep
    d = docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    for base in _bases():
        every = d.mapInArrow(_counter(base), "k long, lang string, word string, n long")
        every = written(every.groupBy("k", "lang", "word").agg(F.sum("n").alias("n")), old)
        mixed_up = every.where("word IS NOT NULL").groupBy("k").agg(F.count("*").alias("words"), F.sum("n").alias("n")).where((F.col("words") > 1) & (F.col("n") >= least))
        if mixed_up.isEmpty():  # else a frequent word shares its hash with another
            break
        dropped(spark, old)
    c = written(every.where((F.col("n") >= least) | F.col("word").isNull()), keep)
    dropped(spark, old)
    totals = c.where("word IS NULL").select("lang", F.col("n").alias("all_words"))
    words = written(_numbered(c.where("word IS NOT NULL"), old), keep)
    dropped(spark, old)
    many, total = words.count(), totals.agg(F.sum("all_words")).first()[0] or 0
    if not many:
        empty = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        return spark.createDataFrame([], empty)
    runs = _packed(d, words, many, total, base).mapInArrow(_runs(least), "size int, hi long, lo long, n long")
    grams = written(runs.groupBy("size", "hi", "lo").agg(F.sum("n").alias("a")).where(F.col("a") >= least), keep)

    w = _ids()
    counts = grams.select("hi", "lo", "a").unionAll(words.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), F.col("n").alias("a")))
    cut = lambda k, n: F.struct(F.lit(k).cast("int").alias("k"), _key(w[:k]).alias("left"), _key(w[k:n]).alias("right"))
    cuts = F.when(F.col("size") == 2, F.array(cut(1, 2))).when(F.col("size") == 3, F.array(cut(1, 3), cut(2, 3))).otherwise(F.array(*[cut(k, 4) for k in (1, 2, 3)]))
    x = grams.select("size", "hi", "lo", "a", F.explode(cuts).alias("cut"))
    for side, name in (("left", "l"), ("right", "r")):
        of = counts.select(F.struct("hi", "lo").alias("of"), F.col("a").alias(name))
        x = x.join(of, F.col(f"cut.{side}") == F.col("of")).drop("of")
    score = F.expr("(cast(2000000 AS decimal(38, 0)) * a) div (cast(l AS decimal(38, 0)) + r)")
    x = x.groupBy("size", "hi", "lo", "a").agg(F.min(F.struct(score.alias("score"), F.col("cut.k"), "l", "r")).alias("least"))
    inside = [(2, _key(w[0:2])), (2, _key(w[1:3]))], [(2, _key(w[0:2])), (2, _key(w[1:3])), (2, _key(w[2:4])), (3, _key(w[0:3])), (3, _key(w[1:4]))]
    longer = grams.where("size > 2").select("a", F.explode(F.when(F.col("size") == 3, F.array(*[s for _, s in inside[0]])).otherwise(F.array(*[s for _, s in inside[1]]))).alias("of"))
    longer = longer.groupBy("of").agg(F.max("a").alias("around"))
    x = x.join(longer, F.struct("hi", "lo") == F.col("of"), "left").drop("of")
    x = x.where(F.expr(f"around IS NULL OR cast(100 AS decimal(38, 0)) * around < cast({within} AS decimal(38, 0)) * a"))
    x = x.select("a", "least.*", *[c.alias(f"w{i}") for i, c in enumerate(w)])
    for i in range(4):
        of = words.select(F.col("id").alias("of"), F.col("word").alias(f"s{i}"), *([F.col("lang").alias("lang")] if not i else []))
        x = x.join(of, F.col(f"w{i}") == F.col("of"), "left").drop("of")
    x = x.select("lang", F.concat_ws(" ", "s0", "s1", "s2", "s3").alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # ranked within parts of a language first: no language meets in one task
    x = x.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return x.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")
