"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Every passage is encoded as shares of its byte classes and word
statistics; gated attention weighs the passages; the weighted representation is scored. Weights are learned from
document labels alone, on a bounded sample of labelled documents; every passage of every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, plain, word_hashes, word_spans

#: SAMPLE documents are fitted on, by SAMPLE_PASSAGES passages each at most; both bound the driver's memory.
PASSAGE, SAMPLE, SAMPLE_PASSAGES, HIDDEN, EPOCHS, RATE = 400, 6000, 256, 16, 250, 0.03

#: Byte classes: each ASCII sign that is no letter, digit or space by itself; letters of either case, digits, spaces, others.
CLASS = np.full(256, 4, np.int64)
for _i, _cs in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 10, 11, 12, 13))):
    CLASS[list(_cs)] = _i
_signs = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASS[_signs] = 5 + np.arange(len(_signs))
CLASSES = 5 + len(_signs)
WIDTH = CLASSES + 4


def encoded(text: str | None) -> np.ndarray:
    """A row for each passage; one row of zeros for an empty text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros((1, WIDTH), np.float32)
    n = max(1, round(len(data) / PASSAGE))
    bounds = np.linspace(0, len(data), n + 1).astype(int)
    at = np.repeat(np.arange(n), np.diff(bounds))
    share = np.bincount(at * CLASSES + CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / np.diff(bounds)[:, None]
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :CLASSES] = np.sqrt(share)
    starts, ends = word_spans(data)
    if len(starts):
        words = word_hashes(LOWER_BYTES[data], starts, ends)
        of = at[starts]
        count = np.bincount(of, minlength=n)
        distinct = np.bincount(of[np.unique((words & ~np.uint64(0xFFFFFF)) | of.astype(np.uint64), return_index=True)[1]], minlength=n)
        new = np.bincount(of[np.unique(words, return_index=True)[1]], minlength=n)
        out[:, CLASSES] = np.bincount(of, ends - starts, n) / np.maximum(count, 1) / 8
        out[:, CLASSES + 1] = distinct / np.maximum(count, 1)
        out[:, CLASSES + 2] = new / np.maximum(count, 1)
        out[:, CLASSES + 3] = np.log1p(np.diff(bounds)) / 6
    return out


def _forward(h: np.ndarray, first: np.ndarray, count: np.ndarray, p: dict) -> tuple:
    t, g = np.tanh(h @ p["V"] + p["vb"]), 1 / (1 + np.exp(-(h @ p["U"] + p["ub"])))
    e = (t * g) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
    a = e / np.repeat(np.add.reduceat(e, first), count)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    s = np.tanh(z @ p["M"] + p["mb"])
    return t, g, a, z, s, s @ p["c"] + p["b"]


def fitted(bags: list[np.ndarray], y: np.ndarray) -> dict:
    """Parameters, by full-batch Adam on the logistic loss. Without both classes, the prior alone."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    rng = np.random.Generator(np.random.PCG64(7))
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"V": draw(WIDTH, HIDDEN), "vb": np.zeros(HIDDEN, np.float32), "U": draw(WIDTH, HIDDEN), "ub": np.zeros(HIDDEN, np.float32), "w": draw(HIDDEN), "M": draw(WIDTH, HIDDEN), "mb": np.zeros(HIDDEN, np.float32), "c": np.zeros(HIDDEN, np.float32), "b": np.float32(np.log(prior / (1 - prior)))}
    p |= {"mean": np.zeros(WIDTH, np.float32), "scale": np.ones(WIDTH, np.float32)}
    if len(y) == 0 or y.min() == y.max():
        return p
    h = np.concatenate(bags)
    p["mean"], p["scale"] = h.mean(0), 1 / np.maximum(h.std(0), 0.02)
    h = (h - p["mean"]) * p["scale"]
    count = np.array([len(b) for b in bags])
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    names = ["V", "vb", "U", "ub", "w", "M", "mb", "c", "b"]
    m1, m2 = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}
    for step in range(1, EPOCHS + 1):
        t, g, a, z, s, logit = _forward(h, first, count, p)
        d = ((1 / (1 + np.exp(-logit))) - y) / len(y)
        ds = d[:, None] * p["c"] * (1 - s**2)
        dz = np.repeat(ds @ p["M"].T, count, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
        grad = {"V": h.T @ dt, "vb": dt.sum(0), "U": h.T @ dg, "ub": dg.sum(0), "w": (t * g).T @ de, "M": z.T @ ds, "mb": ds.sum(0), "c": s.T @ d, "b": d.sum()}
        for k in names:
            q = grad[k] + (1e-4 * p[k] if p[k].ndim == 2 else 0)
            m1[k] = 0.9 * m1[k] + 0.1 * q
            m2[k] = 0.999 * m2[k] + 0.001 * q**2
            p[k] = (p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def scored(bag: np.ndarray, p: dict) -> tuple[float, np.ndarray]:
    """A bag's probability of quality 1 and its passages' attention weights."""
    h = (bag - p["mean"]) * p["scale"]
    *_, a, _, _, logit = _forward(h, np.array([0]), np.array([len(h)]), p)
    return float(1 / (1 + np.exp(-np.clip(logit[0], -30, 30)))), a


def learned(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", key: str = "doc_id", label: str = "quality") -> dict:
    """Fit on a sample of the labelled rows where train holds: those with the least hashes of the key; of a document of
    over SAMPLE_PASSAGES passages, as many at even distances."""
    y = labels.where(train & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(label).cast("double").alias("y"))
    chosen = y.orderBy(F.xxhash64("key"), "key").limit(SAMPLE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # of a longer document, passages at even distances
            bags = [x[np.linspace(0, len(x) - 1, min(len(x), SAMPLE_PASSAGES)).astype(int)].ravel() for x in map(encoded, b["text"])]
            yield pd.DataFrame({"key": b["key"], "y": b["y"], "bag": pd.Series(bags, b.index, object)})

    kind = docs.schema[key].dataType.simpleString()
    d = plain(docs, key, text).toDF("key", "text").join(F.broadcast(chosen), "key")  # SAMPLE rows at most
    rows = d.mapInPandas(run, f"key {kind}, y double, bag array<float>").toArrow().to_pandas().drop_duplicates("key").sort_values("key", kind="stable")
    return fitted([np.asarray(b, np.float32).reshape(-1, WIDTH) for b in rows.bag], rows.y.to_numpy())


def judged(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", key: str = "doc_id", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """Rows (key, score, predicted, passages, attention_peak), one per row of docs.

    Null and empty texts are one passage of zeros and get a score too. Null labels and null keys of labels are
    ignored; several labels of a key count as the least; without labels of both classes all scores are the prior.
    Keys of docs may be null or repeated; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, train, text, key, label))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        for b in batches:
            rows = []
            for t in b.iloc[:, 1]:
                bag = encoded(t)
                s, a = scored(bag, p)
                rows.append((s, int(s >= threshold), len(bag), float(a.max())))
            s, q, n, top = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pd.DataFrame({key: b.iloc[:, 0], "score": np.array(s, float), "predicted": np.array(q, np.int32), "passages": np.array(n, np.int32), "attention_peak": np.array(top, float)})

    d = plain(docs, key, text)
    return d.mapInPandas(run, f"{key} {d.schema[key].dataType.simpleString()}, score double, predicted int, passages int, attention_peak double")
