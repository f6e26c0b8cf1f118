"""Shared helpers: folds, byte-level words and their hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import components, dropped, shared_dir, written

__all__ = ["components", "dropped", "shared_dir", "written"]

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names can't interfere."""
    return docs.select(*[docs[c] for c in cols])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(column: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo: the fixed folds of labelled rows. A null key has remainder 0."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of the bytes; bytes.split() splits on exactly space and 09-0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], space.view(np.int8), [1])))) 
    return edge[::2], edge[1::2]


#: ASCII lower case as a table over bytes.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each word: sum of bytes times powers of an odd base from the word's start, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    span = int((ends - starts).max())
    base = np.uint64(odd)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(span, base, np.uint64))
        at = np.arange(len(data)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
        value = (data.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(at, span - 1)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        return mixed(sums[ends] - sums[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingle_values(text: str | None, size: int) -> np.ndarray:
    """A 64-bit hash of each shingle of the ASCII-lower-cased words, repeats included; of the whole sequence if there
    are fewer words; none without words."""
    data = LOWER_BYTES[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(data):
        return np.zeros(0, np.uint64)
    w = word_hashes(data, *word_spans(data))
    if not len(w):
        return w
    k = min(size, len(w))
    with np.errstate(over="ignore"):
        s = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            s = s * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i]
        return mixed(s)
