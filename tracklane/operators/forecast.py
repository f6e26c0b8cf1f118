"""Forecasts of relations and of the series they act on.

Every fit is a sum over rows, added up in tasks (matrix_sum), and a small system that the driver solves: moments of
latents are at most MOST_LATENTS squared. Latents are rows (session, t, z): neighbours in t within a session are a
step apart, sessions never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrices import matrix_sum

MOST_LATENTS, MOST_SNAPSHOTS = 512, 2048


def stable(phi: np.ndarray, target: float = 0.98) -> np.ndarray:
    """phi scaled down to a spectral radius of target if it has that or more."""
    radius = np.abs(np.linalg.eigvals(phi)).max() if phi.size else 0.0
    return phi * (target / radius) if np.isfinite(radius) and radius >= target else phi


def ahead(c: np.ndarray, phi: np.ndarray, z: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        z = c + phi @ z
    return z


def steps_of(latents: DataFrame) -> DataFrame:
    """(x, y): each latent and the next one of its session."""
    w = Window.partitionBy("session").orderBy("t")
    return latents.select(F.col("z").alias("x"), F.lead("z").over(w).alias("y")).where("y is not null")


def moments(latents: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over steps of [1 x][1 x]' and of [1 x] y'."""
    if d > MOST_LATENTS:
        raise ValueError(f"{d} latents; at most {MOST_LATENTS}")

    def part(b: pd.DataFrame) -> np.ndarray:
        x, y = np.stack(b["x"].to_list()), np.stack(b["y"].to_list())
        x = np.hstack([np.ones((len(x), 1)), x])
        return np.hstack([x.T @ x, x.T @ y])

    s = matrix_sum(steps_of(latents), part, (d + 1, 2 * d + 1))
    return s[:, : d + 1], s[:, d + 1 :]


def ridge_var(latents: DataFrame, d: int, ridge: float = 1e-2, intercept: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(c, phi) of z' = c + phi z by ridge regression; the intercept isn't shrunk. Without steps all are zero."""
    xx, xy = moments(latents, d)
    if not xx[0, 0]:
        return np.zeros(d), np.zeros((d, d))
    if not intercept:
        return np.zeros(d), np.linalg.solve(xx[1:, 1:] + ridge * np.eye(d), xy[1:]).T
    b = np.linalg.solve(xx + ridge * np.diag([0.0] + [1.0] * d), xy)
    return b[0], b[1:].T


def standardised(latents: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Latents less their means over standard deviations (1 where about zero), and both."""
    rows = latents.select(F.posexplode("z")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_samp("col").alias("s")).orderBy("pos").collect()
    mean, std = np.array([r["m"] for r in rows]), np.array([r["s"] if r["s"] and r["s"] > 1e-6 else 1.0 for r in rows])
    params = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, std, strict=True)])
    return latents.withColumn("z", F.zip_with("z", params, lambda x, p: (x - p["m"]) / p["s"])), mean, std


# Factors of pairs: a principal-component model over vectors of pairs, whose length may be very large; snapshots are
# few. So the Gram matrix of snapshots is summed over pairs, and loadings stay distributed.


class Factors(NamedTuple):
    pairs: DataFrame  # (i, j, mean, load)
    transition: np.ndarray


def pair_factors(relations: DataFrame, rank: int = 12, ridge: float = 1e-3, most: int = MOST_SNAPSHOTS) -> Factors:
    """Model of rows (t, i, j, value), one for each pair and snapshot; missing ones are 0. Scores of a snapshot follow
    a ridge VAR(1) without intercept over consecutive snapshots."""
    times = [r[0] for r in relations.select("t").distinct().orderBy("t").limit(most + 1).collect()]
    if len(times) > most:
        raise ValueError(f"over {most} snapshots; choose some of them first")
    at, n = {t: k for k, t in enumerate(times)}, len(times)
    wide = relations.groupBy("i", "j").agg(F.collect_list(F.struct("t", "value")).alias("cells"))

    def rows(b: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(b), n))
        for k, cells in enumerate(b["cells"]):
            for c in cells:
                x[k, at[c["t"]]] = c["value"] or 0.0
        return x

    def part(b: pd.DataFrame) -> np.ndarray:
        x = rows(b)
        x -= x.mean(1, keepdims=True)
        return x.T @ x

    w, v = np.linalg.eigh(matrix_sum(wide, part, (n, n)))
    top = [k for k in np.argsort(-w) if w[k] > 1e-12 * max(w.max(), 1e-300)][: min(rank, max(1, n - 1))]
    size = np.sqrt(w[top])
    scores, basis = v[:, top] * size, v[:, top] / size
    k = len(top)
    a = np.linalg.solve(scores[:-1].T @ scores[:-1] + ridge * np.eye(k), scores[:-1].T @ scores[1:]) if n > 1 else np.eye(k)

    def loads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = rows(b)
            m = x.mean(1)
            yield pd.DataFrame({"i": b["i"], "j": b["j"], "mean": m, "load": list((x - m[:, None]) @ basis)})

    kinds = {c: relations.schema[c].dataType.simpleString() for c in "ij"}
    return Factors(wide.mapInPandas(loads, f"i {kinds['i']}, j {kinds['j']}, mean double, load array<double>"), a)


def factor_forecast(model: Factors, relations: DataFrame, horizons: list[int]) -> DataFrame:
    """(t, h, i, j, value): the model's relation h steps after snapshot t, for every pair of relations."""
    known = relations.join(model.pairs, ["i", "j"])
    part = known.select("t", F.posexplode("load").alias("k", "l"), (F.col("value") - F.col("mean")).alias("x"))
    scores = part.groupBy("t", "k").agg(F.sum(F.col("x") * F.col("l")).alias("s")).groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("s"))
    powers = {h: np.linalg.matrix_power(model.transition, h) for h in horizons}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, p in powers.items():
                yield pd.DataFrame({"t": b["t"], "h": h, "s": [np.asarray(s) @ p for s in b["s"]]})

    later = scores.mapInPandas(run, "t bigint, h bigint, s array<double>")
    dot = F.aggregate(F.zip_with("load", "s", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return known.select("t", "i", "j", "mean", "load").join(later, "t").select("t", "h", "i", "j", (F.col("mean") + dot).alias("value"))


# Factorised snapshots: G is about mean + U X V', latents X small.


class Bases(NamedTuple):
    mean: np.ndarray
    u: np.ndarray
    v: np.ndarray


def mean_snapshot(snaps: DataFrame, n: int) -> np.ndarray:
    return matrix_sum(snaps, lambda b: np.sum(np.stack(b["m"].to_list()), axis=0).reshape(n, n), (n, n)) / max(snaps.count(), 1)


def leading(m: np.ndarray, rank: int) -> np.ndarray:
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1][:, :rank]


def symmetric_bases(snaps: DataFrame, n: int, rank: int = 12) -> Bases:
    """U = V: the leading eigenvectors of the mean."""
    mean = mean_snapshot(snaps, n)
    u = leading(mean, rank)
    return Bases(mean, u, u)


def directed_bases(snaps: DataFrame, n: int, rank: int = 16) -> Bases:
    """U and V: the leading eigenvectors of the covariance of rows and of columns."""
    mean = mean_snapshot(snaps, n)

    def part(b: pd.DataFrame) -> np.ndarray:
        out = np.zeros((n, 2 * n))
        for m in b["m"]:
            c = np.asarray(m).reshape(n, n) - mean
            out += np.hstack([c @ c.T, c.T @ c])
        return out

    s = matrix_sum(snaps, part, (n, 2 * n))
    return Bases(mean, leading(s[:, :n], rank), leading(s[:, n:], rank))


def compressed(snaps: DataFrame, bases: Bases) -> DataFrame:
    """Latents U'(G - mean)V, row by row."""
    mean, u, v = bases
    n = len(mean)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"session": b["session"], "t": b["t"], "z": [(u.T @ (np.asarray(m).reshape(n, n) - mean) @ v).ravel() for m in b["m"]]})

    return snaps.mapInPandas(run, "session string, t bigint, z array<double>")


def restored(z: np.ndarray, bases: Bases) -> np.ndarray:
    mean, u, v = bases
    return mean + u @ z.reshape(u.shape[1], v.shape[1]) @ v.T


def matrix_autoregression(latents: DataFrame, p: int, q: int, ridge: float = 1e-3, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) of X' = A X B'. Starts at the nearest Kronecker product of a ridge VAR and alternates least squares. All
    rounds use the second moments of one pass: sums of products of cells, as arrays with four axes."""
    xx, xy = moments(latents, p * q)
    s00, s01 = xx[1:, 1:], xy[1:]
    phi = np.linalg.solve(s00 + ridge * np.eye(p * q), s01).T
    w, s, t = np.linalg.svd(phi.reshape(p, q, p, q).transpose(0, 2, 1, 3).reshape(p * p, q * q))
    a, b = np.sqrt(s[0]) * w[:, 0].reshape(p, p), np.sqrt(s[0]) * t[0].reshape(q, q)
    now, step = s00.reshape(p, q, p, q), s01.T.reshape(p, q, p, q)
    for _ in range(rounds):
        b = np.einsum("abcd,ac->bd", step, a) @ np.linalg.inv(np.einsum("abcd,ac->bd", now, a.T @ a) + ridge * np.eye(q))
        a = np.einsum("abcd,bd->ac", step, b) @ np.linalg.inv(np.einsum("abcd,bd->ac", now, b.T @ b) + ridge * np.eye(p))
        size = max(np.linalg.norm(a), 1e-12)
        a, b = a / size, b * size
    return a, b


def action(bases: Bases, latent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The restored relation times x, without building it."""
    mean, u, v = bases
    return mean @ x + u @ (latent.reshape(u.shape[1], v.shape[1]) @ (v.T @ x))


def forecast_actions(latents: DataFrame, values: DataFrame, bases: Bases, mean: np.ndarray, std: np.ndarray, c: np.ndarray, phi: np.ndarray, horizons: list[int]) -> DataFrame:
    """(t, h, y): the relation h steps after t times the values (t, x) of that t, x in the order of nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, z, x in zip(b["t"], b["z"], b["x"], strict=True):
                z0 = (np.asarray(z) - mean) / std
                out = [action(bases, ahead(c, phi, z0, h) * std + mean, np.asarray(x)) for h in horizons]
                yield pd.DataFrame({"t": t, "h": horizons, "y": out})

    return latents.select("t", "z").join(values.select("t", "x"), "t").mapInPandas(run, "t bigint, h bigint, y array<double>")


# Recursive least squares: coefficients that change along a session.


class Recursion:
    """Coefficients theta = [c phi'] of a session, which start at (c, phi); kept stable after each step."""

    def __init__(self, c: np.ndarray, phi: np.ndarray, ridge: float = 1e-2, forgetting: float = 0.98):
        self.theta, self.p = np.vstack([c, stable(phi).T]), np.eye(len(c) + 1) / max(ridge, 1e-4)
        self.before, self.forgetting = None, forgetting

    def take(self, z: np.ndarray) -> np.ndarray:
        """Takes the next latent and gives theta as known then."""
        if self.before is not None:
            x = np.concatenate([[1.0], self.before])
            px = self.p @ x
            gain = px / max(self.forgetting + x @ px, 1e-12)
            theta = self.theta + np.outer(gain, z - x @ self.theta)
            p = (self.p - np.outer(gain, px)) / self.forgetting
            self.theta, self.p = np.vstack([theta[0], stable(theta[1:].T).T]), (p + p.T) / 2
        self.before = z
        return self.theta


def time_varying(latents: DataFrame, c: np.ndarray, phi: np.ndarray, ridge: float = 1e-2, forgetting: float = 0.98) -> DataFrame:
    """(session, t, theta): Recursion's coefficients, row by row, as known at t. A session, such as a day of slots, is
    one task's work."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, r = g.sort_values("t"), Recursion(c, phi, ridge, forgetting)
        return pd.DataFrame({"session": g["session"], "t": g["t"], "theta": [r.take(np.asarray(z)).ravel() for z in g["z"]]})

    return latents.groupBy("session").applyInPandas(run, "session string, t bigint, theta array<double>")


# Regression of next relations on seven features of each target node's present ones.


def target_features(g: np.ndarray, j: int) -> np.ndarray:
    one = np.ones(len(g))
    return np.stack([one, g[:, j], g[j], g.mean(1), np.abs(g).mean(1), one * g[:, j].mean(), one * np.abs(g[:, j]).mean()], axis=1)


def target_regression(snaps: DataFrame, n: int, ridge: float = 1e-2, keep: int = 4) -> np.ndarray:
    """Coefficients, seven for each target node: ridge regression (the constant isn't shrunk), of the others only the
    keep largest."""

    def part(b: pd.DataFrame) -> np.ndarray:
        out = np.zeros((n, 56))
        for x, y in zip(b["x"], b["y"], strict=True):
            g, later = np.asarray(x).reshape(n, n), np.asarray(y).reshape(n, n)
            for j in range(n):
                f = target_features(g, j)
                out[j] += np.hstack([f.T @ f, f.T @ later[:, j : j + 1]]).ravel()
        return out

    s = matrix_sum(steps_of(snaps.withColumnRenamed("m", "z")), part, (n, 56)).reshape(n, 7, 8)
    beta = np.stack([np.linalg.solve(m[:, :7] + ridge * np.diag([0.0] + [1.0] * 6) + 1e-12 * np.eye(7), m[:, 7]) for m in s])
    rank = np.argsort(np.argsort(-np.abs(beta[:, 1:]), axis=1, kind="stable"), axis=1)
    beta[:, 1:][rank >= keep] = 0.0
    return beta


def target_forecast(g: np.ndarray, beta: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        g = np.stack([target_features(g, j) @ beta[j] for j in range(len(g))], axis=1)
    return g


def elastic_net(rows: DataFrame, p: int, q: int, alpha: float = 0.001, ratio: float = 0.5, rounds: int = 1000, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(constants, weights p by q) of y = constants + x W for rows (x, y): squares over 2n, plus alpha times ratio times
    the sum of the norms of W's rows, plus half of alpha times the rest times W's squares. Block coordinate descent on
    centred moments, which one pass over the rows gives."""
    if p > 2 * MOST_LATENTS:
        raise ValueError(f"{p} columns; at most {2 * MOST_LATENTS}")

    def part(b: pd.DataFrame) -> np.ndarray:
        x = np.hstack([np.ones((len(b), 1)), np.stack(b["x"].to_list())])
        return np.hstack([x.T @ x, x.T @ np.stack(b["y"].to_list())])

    s = matrix_sum(rows.select("x", "y"), part, (p + 1, p + 1 + q))
    n = s[0, 0]
    w = np.zeros((p, q))
    if not n:
        return np.zeros(q), w
    mx, my = s[0, 1 : p + 1] / n, s[0, p + 1 :] / n
    xx, xy = s[1:, 1 : p + 1] / n - np.outer(mx, mx), s[1:, p + 1 :] / n - np.outer(mx, my)
    for _ in range(rounds):
        most = 0.0
        for k in range(p):
            r = xy[k] - xx[k] @ w + xx[k, k] * w[k]
            size, below = np.linalg.norm(r), xx[k, k] + alpha * (1 - ratio)
            new = r * max(0.0, 1 - alpha * ratio / size) / below if size and below > 1e-15 else np.zeros(q)
            most, w[k] = max(most, np.abs(new - w[k]).max()), new
        if most < tolerance:
            break
    return my - mx @ w, w


def arma(values: np.ndarray, steps: int, long: int = 4) -> np.ndarray:
    """Forecasts of an ARMA(1,1) with constant, estimated in two regressions: a long autoregression gives the shocks,
    then values are regressed on the last value and shock. Short or constant series repeat their mean."""
    v = np.asarray(values, float)
    if len(v) < 2 * long + 4 or v.std() < 1e-9:
        return np.full(steps, v.mean() if len(v) else 0.0)
    lags = np.stack([v[long - k - 1 : len(v) - k - 1] for k in range(long)], axis=1)
    x = np.hstack([np.ones((len(lags), 1)), lags])
    shock = v[long:] - x @ np.linalg.lstsq(x, v[long:], rcond=None)[0]
    y = v[long + 1 :]
    x = np.stack([np.ones(len(y)), v[long:-1], shock[:-1]], axis=1)
    c, a, m = np.linalg.lstsq(x, y, rcond=None)[0]
    a, m = np.clip(a, -0.99, 0.99), np.clip(m, -0.99, 0.99)
    c = y.mean() - a * x[:, 1].mean() - m * x[:, 2].mean()
    out, last, e = [], v[-1], shock[-1]
    for _ in range(steps):
        last, e = c + a * last + m * e, 0.0
        out.append(last)
    return np.array(out)


def arma_forecast(series: DataFrame, node: str, time: str, value: str, steps: int = 12) -> DataFrame:
    """(node, h, value) of each node's own ARMA(1,1); a node's history is one task's work."""
    kind = series.schema[node].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values(time)[value].dropna().to_numpy()
        return pd.DataFrame({"node": g[node].iloc[0], "h": np.arange(1, steps + 1), "value": arma(v, steps)})

    return series.where(F.col(node).isNotNull()).select(node, time, value).groupBy(node).applyInPandas(run, f"node {kind}, h bigint, value double")
