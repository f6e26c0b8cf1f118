"""Best-fit packing of token sequences.

Documents are tokenized where they lie; what travels is a row per piece with its length. Pieces are dealt evenly to
packers by a hash of document and piece; each packer runs bounded-space online best-fit: a fixed number of open
bins in a bitset keyed by free space; a piece goes to the fullest bin that takes it, and when no place for another
open bin is left, the fullest closes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, written

CAPACITY, OPEN_BINS, END, PER_PACKER = 2048, 4096, 0, 10_000
#: Code points below this one are in both libraries' letter, number and space classes alike (tested).
SAME_CLASSES = 0x250


def tokenizer(path: str):
    """A function of a text that gives its ids under the vocabulary file (tokenizers' JSON), as tokenizers itself does
    without adding special tokens; the strings of added tokens in a text are these tokens.

    A byte-level BPE file whose pre-tokenizer is the usual one is applied through the same merges in tiktoken, which
    is five times as fast, for texts of code points below SAME_CLASSES without an added token's string; other texts,
    and other files, through tokenizers itself. Kept by the worker process, beside the library's own module.
    """
    import tiktoken
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_by_path", {})
    if path in kept:
        return kept[path]
    import json

    full = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = lambda t: full.encode(t, add_special_tokens=False).ids
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" and not spec.get("normalizer")
    if not usual:
        kept[path] = slow
        return slow
    # bytes as the printable characters of byte-level vocabularies: visible ones stand for themselves, others are from 256 on
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    added = [t["content"] for t in spec.get("added_tokens") or []]
    chars = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
    ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if all(c in chars for c in token) and token not in added}
    # in rank order, ids of merged tokens ascend with their merges, so that both libraries merge in the same order
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        kept[path] = slow
        return slow
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    quick = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    limit = chr(SAME_CLASSES)

    def encode(text: str) -> list[int]:
        plain = (text.isascii() or max(text) < limit) and not any(a in text for a in added)
        return quick.encode_ordinary(text) if plain else slow(text)

    kept[path] = encode
    return encode


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32): a document's ids and an END; those over the capacity are cut,
    the first piece being the shorter one. Null and empty texts are one piece of END alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path)
        for b in batches:
            rows = []
            for k, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                ids = np.array([*(encode(t) if t else ()), END], "<u4")
                first = len(ids) % capacity or capacity
                for i, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first + i * capacity]
                    rows.append((k, i, start, len(part), zlib.crc32(part.tobytes())))
            out = pd.DataFrame(rows, columns=[key, "piece", "start", "length", "ids_crc32"])
            yield out.astype({key: b.dtypes.iloc[0]} if len(out) else {})

    d = plain(docs, key, text)
    return d.mapInPandas(run, f"{key} {d.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """A bin and an offset for each length, in order."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n_open = n = 0
    for length in lengths:
        fits = mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            if n_open == open_bins:
                space = (mask & -mask).bit_length() - 1  # the fullest
                free[space].pop()
                if not free[space]:
                    mask ^= 1 << space
                n_open -= 1
            b, space, n = n, capacity, n + 1
            n_open += 1
        yield b, capacity - space
        left = space - length
        if left:
            free[left].append(b)
            mask |= 1 << left
        else:
            n_open -= 1


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """pieces() with sequence_id and offset: sequences of at most capacity ids, each filled from 0 without gaps.

    Every row of docs is packed, repeated ones and those with a null key too; an empty table gives no rows.
    """
    p = written(pieces(docs, path, capacity, text, key))  # the caller's result reads this table, so it stays
    packers = -(-p.count() // PER_PACKER) or 1
    dealt = p.repartition(packers, F.xxhash64(key, "piece", "ids_crc32")).sortWithinPartitions(F.desc("length"), key, "piece", "ids_crc32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, last = TaskContext.get().partitionId(), [0]

        def lengths():
            while True:
                yield last[0]

        bins = best_fit(lengths(), capacity, open_bins)
        for b in batches:
            places = []
            for last[0] in b.length.tolist():
                places.append(next(bins))
            at = np.array(places, np.int64).reshape(-1, 2)
            yield b.assign(sequence_id=(task << 33) + at[:, 0], offset=at[:, 1])

    return dealt.mapInPandas(run, f"{p._jdf.schema().toDDL()}, sequence_id long, offset long")
