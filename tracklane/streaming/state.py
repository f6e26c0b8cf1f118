"""Recursions over streams, with a small state for each key that outlives lost executors in the query's checkpoint.

Rows of a micro-batch are taken in the order of time; batches in that of their arrival, so a topic keyed like the
state gives the rows of the batch twins. Rows without a value are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.forecast import Recursion


def running_ema(stream: DataFrame, key: str, time: str, value: str, span: int = 6) -> DataFrame:
    """(key, time, ema): the recursive exponential mean up to each row; the first value starts it."""
    a = 2 / (span + 1)
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, time)}

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(batches)).sort_values(time, kind="stable")
        last, out = (state.get[0] if state.exists else None), []
        for x in g["__value"]:
            last = x if last is None else last * (1 - a) + x * a
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({key: g[key], time: g[time], "ema": out})

    rows = stream.select(key, time, F.col(value).cast("double").alias("__value")).where("__value is not null")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {time} {kinds[time]}, ema double", "last double", "append", GroupStateTimeout.NoTimeout)


def running_rls(latents: DataFrame, c: np.ndarray, phi: np.ndarray, ridge: float = 1e-2, forgetting: float = 0.98) -> DataFrame:
    """(session, t, theta) of a stream of latents (session, t, z), as forecast.time_varying() gives for a table."""
    d = len(c)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(batches)).sort_values("t")
        r = Recursion(c, phi, ridge, forgetting)
        if state.exists:
            theta, p, before = (np.array(x) for x in state.get)
            r.theta, r.p, r.before = theta.reshape(d + 1, d), p.reshape(d + 1, d + 1), before
        out = [r.take(np.asarray(z)).ravel() for z in g["z"]]
        state.update((r.theta.ravel().tolist(), r.p.ravel().tolist(), r.before.tolist()))
        yield pd.DataFrame({"session": g["session"], "t": g["t"], "theta": out})

    rows = latents.select("session", "t", "z").where("z is not null")
    return rows.groupBy("session").applyInPandasWithState(run, "session string, t bigint, theta array<double>", "theta array<double>, p array<double>, before array<double>", "append", GroupStateTimeout.NoTimeout)


class SessionCovariance(StatefulProcessor):
    """Sums of a band of rows of a session's covariance: n, the offset, sums of x and of x x', and their exponential twins."""

    def __init__(self, band: int, gap_ms: int, decay: float):
        self.band, self.gap_ms, self.decay = band, gap_ms, decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n bigint, nodes int, off array<double>, x array<double>, xx array<double>, e array<double>, ee array<double>")
        self.ends = handle.getValueState("ends", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(rows)).sort_values("at", kind="stable")
        x = np.array(g["x"].tolist(), float)
        own = slice(key[1] * self.band, (key[1] + 1) * self.band)
        if self.sums.exists():
            n, nodes, *rest = self.sums.get()
            off, sx, sxx, e, ee = (np.array(v, float) for v in rest)
            sxx, ee = sxx.reshape(-1, nodes), ee.reshape(-1, nodes)
        else:  # sums of differences from the first snapshot lose less
            n, nodes, off = 0, x.shape[1], x[0]
            sx, e = np.zeros(nodes), np.zeros(nodes)
            sxx = np.zeros((len(off[own]), nodes))
            ee = np.zeros_like(sxx)
        for v in x - off:
            outer = v[own, None] * v[None, :]
            sx, sxx = sx + v, sxx + outer
            e, ee = self.decay * e + (1 - self.decay) * v, self.decay * ee + (1 - self.decay) * outer
        self.sums.update((int(n + len(x)), int(nodes), off.tolist(), sx.tolist(), sxx.ravel().tolist(), e.tolist(), ee.ravel().tolist()))
        end = int(g["at"].max().value // 1_000_000) + self.gap_ms
        if self.ends.exists():
            before = self.ends.get()[0]
            end = max(end, before)
            self.handle.deleteTimer(before)
        self.ends.update((end,))
        self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, nodes, *rest = self.sums.get()
        _, sx, sxx, e, ee = (np.array(v, float) for v in rest)
        first = key[1] * self.band
        rows = np.arange(first, min(first + self.band, nodes))
        m, left = sx / n, self.decay**n
        cov = left * (sxx.reshape(-1, nodes) / n - m[rows, None] * m) + ee.reshape(-1, nodes) - e[rows, None] * m - m[rows, None] * e + (1 - left) * m[rows, None] * m
        self.sums.clear()
        self.ends.clear()
        i, j = np.nonzero(rows[:, None] <= np.arange(nodes))
        yield pd.DataFrame({"session": key[0], "i": rows[i], "j": j, "n": n, "cov": cov[i, j]})

    def close(self) -> None:
        pass


def session_covariance(snapshots: DataFrame, gap: str = "1 hour", decay: float = 0.94, nodes: int = 256, band: int = 256) -> DataFrame:
    """(session, i, j, n, cov), i <= j, of each session when it ends: the recursion S <- decay S + (1 - decay) x x' from
    the sample covariance on, over centred values, as a state of sums that any cutting into batches leaves the same.

    snapshots are a stream (session, at, x) with a watermark on at, x the values of nodes 0, 1, ... of one length, at
    most nodes; each session's come in order of time. A state holds band rows of the matrix, and a snapshot goes to
    the states of all bands. A session ends when the watermark has passed its last snapshot by gap; what comes for it
    later is a new one. Set the session's state store to features.PROVIDER first.
    """
    ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    bands = F.sequence(F.lit(0), F.least(F.lit(-(-nodes // band)), F.ceil(F.size("x") / band)).cast("int") - 1)
    s = snapshots.where("session IS NOT NULL AND size(x) > 0").select("session", "at", "x", F.explode(bands).alias("band"))
    return s.groupBy("session", "band").transformWithStateInPandas(SessionCovariance(band, ms, decay), "session string, i bigint, j bigint, n bigint, cov double", "Append", "EventTime")
