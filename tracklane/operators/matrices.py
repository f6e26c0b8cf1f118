"""Dense snapshots of relations: one row (session, t, m) for each square matrix, m row by row.

A snapshot is a row, so its size is checked: at most MOST_NODES nodes. Sums over snapshots are added up in tasks, then
row by row; the driver gets one matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NODES = 4096
SNAPSHOT = "session string, t bigint, m array<double>"


def node_list(relations: DataFrame, most: int = MOST_NODES) -> list:
    """The distinct nodes in their order; an error if there are more than most."""
    nodes = [r[0] for r in relations.select(F.explode(F.array("i", "j")).alias("n")).where("n is not null").distinct().orderBy("n").limit(most + 1).collect()]
    if len(nodes) > most:
        raise ValueError(f"over {most} nodes; choose some of them first")
    return nodes


def snapshots(relations: DataFrame, nodes: list, mirrored: bool = True, diagonal: float = 1.0) -> DataFrame:
    """Snapshots of rows (session, t, i, j, value). Pairs that are missing or null are 0; of repeated rows the largest
    value counts; mirrored: rows with i < j stand for both directions."""
    n, of = len(nodes), {x: k for k, x in enumerate(nodes)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cells in b["cells"]:
                m = np.zeros((n, n))
                i, j = [of[c["i"]] for c in cells], [of[c["j"]] for c in cells]
                v = [c["value"] or 0.0 for c in cells]
                m[i, j] = v
                if mirrored:
                    m[j, i] = v
                np.fill_diagonal(m, diagonal)
                out.append(m.ravel())
            yield pd.DataFrame({"session": b["session"], "t": b["t"], "m": out})

    one = relations.where("i is not null and j is not null").groupBy("session", "t", "i", "j").agg(F.max("value").alias("value"))
    rows = one.groupBy(F.col("session").cast("string").alias("session"), F.col("t").cast("bigint").alias("t")).agg(F.collect_list(F.struct("i", "j", "value")).alias("cells"))
    return rows.mapInPandas(run, SNAPSHOT)


def matrix_sum(df: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over df's batches of the matrices that part gives; zeros for an empty table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += part(b)
        if total.any():
            yield pd.DataFrame({"r": np.arange(shape[0], dtype=np.int32), "v": list(total)})

    def added(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": g["r"].iloc[:1], "v": [np.sum(np.stack(g["v"].to_list()), axis=0)]})

    out = np.zeros(shape)
    for r in df.mapInPandas(run, "r int, v array<double>").groupBy("r").applyInPandas(added, "r int, v array<double>").collect():
        out[r["r"]] = r["v"]
    return out


def mapped(snaps: DataFrame, f: Callable[[np.ndarray], np.ndarray], n: int) -> DataFrame:
    """Each snapshot's n by n matrix replaced by f of it, flattened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"session": b["session"], "t": b["t"], "m": [np.ravel(f(np.asarray(m).reshape(n, n))) for m in b["m"]]})

    return snaps.mapInPandas(run, SNAPSHOT)


def long_rows(snaps: DataFrame, nodes: list, upper: bool = True) -> DataFrame:
    """Rows (session, t, i, j, value) of snapshots: i before j only, or both directions without the diagonal."""
    n = len(nodes)
    kind = "string" if nodes and isinstance(nodes[0], str) else "bigint"
    a, b = np.triu_indices(n, 1) if upper else np.nonzero(~np.eye(n, dtype=bool))
    names = np.array(nodes, dtype=object if kind == "string" else np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, t, m in zip(batch["session"], batch["t"], batch["m"], strict=True):
                yield pd.DataFrame({"session": s, "t": t, "i": names[a], "j": names[b], "value": np.asarray(m).reshape(n, n)[a, b]})

    return snaps.mapInPandas(run, f"session string, t bigint, i {kind}, j {kind}, value double")


def nearest_correlation(m: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """The matrix made symmetric, its eigenvalues lifted to the floor, rescaled to a diagonal of 1."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    x = (v * np.maximum(w, floor)) @ v.T
    s = 1 / np.sqrt(np.maximum(np.diag(x), floor))
    x = np.clip(x * s[:, None] * s[None, :], -1, 1)
    np.fill_diagonal(x, 1.0)
    return x


def laplacian_vectors(weights: np.ndarray, count: int) -> np.ndarray:
    """Eigenvectors of the smallest eigenvalues of D - A, in columns, padded with zeros to count; the first cell of
    each that isn't about zero is positive."""
    a = weights * (1 - np.eye(len(weights)))
    v = np.linalg.eigh(np.diag(a.sum(1)) - a)[1][:, :count]
    for k in range(v.shape[1]):
        big = np.flatnonzero(np.abs(v[:, k]) > 1e-9)
        v[:, k] *= np.sign(v[big[0], k]) if len(big) else 1
    return np.pad(v, ((0, 0), (0, count - v.shape[1])))


def regions(corr: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Spectral clusters of a matrix of correlations, by the absolute values as affinities: rows of the leading
    eigenvectors of the normalised affinity, k-means from far-apart starts. Labels count up by first member."""
    a = np.abs(corr) * (1 - np.eye(len(corr)))
    s = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
    x = np.linalg.eigh(a * s[:, None] * s[None, :])[1][:, -k:]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = [x[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmax(np.min([((x - c) ** 2).sum(1) for c in centres], axis=0))])
    c = np.array(centres)
    for _ in range(rounds):
        label = np.argmin(((x[:, None] - c[None]) ** 2).sum(2), axis=1)
        new = np.array([x[label == q].mean(0) if (label == q).any() else c[q] for q in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    order: dict = {}
    return np.array([order.setdefault(q, len(order)) for q in label])
