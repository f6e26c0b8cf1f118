"""Correlations of all pairs of nodes, of which a task holds one tile at a time.

Nodes are a row each, with their times and values, and are dealt to bands by hash. A pair of bands is one task, which
goes through the matrix of correlations between its nodes by tiles and hands each to what makes rows of it: pairs,
sums, counts, the best partners, products with vectors. So a value is shuffled once for each band, whose number doesn't
grow until bands have WIDEST values, and pairs themselves are never shuffled or stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from . import graphs

#: Nodes of a side of a tile, bands (fewer for few nodes), values of a band, and cells of a dense side of a tile.
BLOCK, BANDS, WIDEST, CELLS = 256, 16, 1 << 22, 1 << 22
#: Rows that a task holds back before it adds them up.
HELD = 1 << 20
#: Of a constant series' mean square what rounding leaves.
FLAT = 1e-12


class Tile(NamedTuple):
    """Correlations r and numbers of common times n of nodes a (rows) and b (columns); ok marks the pairs that count:
    those with a common time, once each. x and y are what rows carry along beside their series. If rows are classes of
    nodes of one series (alike()), w has the number of pairs of nodes that a cell stands for, those within a class too."""

    a: np.ndarray
    b: np.ndarray
    r: np.ndarray
    n: np.ndarray
    ok: np.ndarray
    x: np.ndarray | None
    y: np.ndarray | None
    w: np.ndarray | None = None
    #: Of pairs of nodes that are named apart (apart()): row, column, part and number of them, which w has too.
    named: tuple[np.ndarray, ...] | None = None


def stored(panel: DataFrame, node: str, time: str, value: str, keep: list[str] | None = None) -> DataFrame:
    """(node, t, v): a row for each node, with its times as numbers, in order, and its values; a table in the shared folder."""
    p = panel.select(F.col(node).alias("node"), F.col(time).alias("t"), F.col(value).cast("double").alias("v")).where("v is not null and node is not null and t is not null")
    kind = panel.schema[time].dataType.typeName()
    number = {"date": F.unix_date, "timestamp": F.unix_micros} | dict.fromkeys(("byte", "short", "integer", "long"), lambda c: F.col(c))
    if kind in number:
        p = p.withColumn("t", number[kind]("t").cast("long"))
    else:
        places = graphs.indexed(p.select("t").distinct(), ["t"], "place")
        p = p.join(places, "t").select("node", F.col("place").cast("long").alias("t"), "v")
    rows = p.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))
    return written(rows.select("node", F.col("s.t").alias("t"), F.col("s.v").alias("v")), keep)


def alike(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(node, t, v, w): rows (stored()) of which those with the same series are one, a class of w nodes named by its
    smallest. What has all pairs of nodes only to count or add them up needs each two classes once."""
    return written(rows.groupBy("t", "v").agg(F.min("node").alias("node"), F.count("*").alias("w")).select("node", "t", "v", "w"), keep)


def members(rows: DataFrame, classes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(node, class): the class (alike()) of each of rows."""
    return written(rows.join(classes.select("t", "v", F.col("node").alias("class")), ["t", "v"]).select("node", "class"), keep)


def apart(classes: DataFrame, of: DataFrame, pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """classes with lists (far, part, number) of pairs (i, j, part) of nodes that are to be told from all others, each once
    in one direction; of (node, class) has the nodes' classes."""
    at = lambda x, y: of.select(F.col("node").alias(x), F.col("class").alias(y))
    one = pairs.join(at("i", "a"), "i").join(at("j", "b"), "j").select("a", "b", "part")
    both = one.unionAll(one.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "part"))
    n = both.groupBy("a", "b", "part").agg(F.count("*").alias("n")).groupBy("a").agg(F.collect_list(F.struct("b", "part", "n")).alias("l"))
    lists = n.select(F.col("a").alias("node"), F.col("l.b").alias("far"), F.col("l.part").alias("part"), F.col("l.n").alias("number"))
    return written(classes.join(lists, "node", "left"), keep)


def with_itself(v: str) -> Column:
    """The correlation of a series v with another of the same values: 1, or 0 of a constant or a single one, as in _tile()."""
    n = F.size(v)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(F.col(v)) / n
    square = total(F.transform(v, lambda x: (x - mean) * (x - mean))) / n
    rest = total(F.transform(v, lambda x: x - mean)) / n
    return F.when((square - rest * rest > FLAT * F.greatest(square, F.lit(1e-300))) & (n > 1), 1.0).otherwise(0.0)


class _Band:
    def __init__(self, parts: list[pd.DataFrame]):
        d = pd.concat(parts)
        name = d["node"].to_numpy()
        order = np.argsort(name, kind="stable")
        self.name = name[order]
        self.x = np.array(d["x"].tolist(), float).reshape(len(d), -1)[order] if "x" in d else None
        self.w = d["w"].to_numpy(np.int64)[order] if "w" in d else None
        self.named = None
        if "far" in d:
            lists = d[["far", "part", "number"]].iloc[order]
            some = lists["far"].notna().to_numpy()
            if some.any():
                far, part, number = (np.concatenate(lists.loc[some, c].tolist()) for c in lists)
                self.named = np.repeat(np.flatnonzero(some), lists.loc[some, "far"].map(len)), far, part, number
        t, v = d["t"].to_numpy()[order], d["v"].to_numpy()[order]
        size = np.array([len(s) for s in t], np.int64)
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.t, self.v = np.concatenate(t), np.concatenate(v).astype(float)
        # values less their node's mean: sums of products stay small and exact
        self.v -= np.repeat(np.add.reduceat(self.v, self.start[:-1]) / size, size)

    def dense(self, low: int, high: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and ones where there are any, of nodes from low to high at all times."""
        s = slice(self.start[low], self.start[high])
        at = np.repeat(np.arange(high - low), np.diff(self.start[low : high + 1])), np.searchsorted(times, self.t[s])
        x, m = np.zeros((high - low, len(times))), np.zeros((high - low, len(times)))
        x[at], m[at] = self.v[s], 1.0
        return x, m


def _tile(x: np.ndarray, m: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of rows of x and y over the cells that m and w both mark, and the numbers of these."""
    n, sx, sy, sxx, syy, sxy = m @ w.T, x @ w.T, m @ y.T, (x * x) @ w.T, m @ (y * y).T, x @ y.T
    inverse = 1 / np.maximum(n, 1)
    for s in (sx, sy, sxx, syy, sxy):
        s *= inverse
    vx, vy = sxx - sx * sx, syy - sy * sy
    ok = (vx > FLAT * np.maximum(sxx, 1e-300)) & (vy > FLAT * np.maximum(syy, 1e-300)) & (n > 1)
    sx *= sy
    sxy -= sx
    vx *= vy
    vx[~ok] = 1.0
    np.sqrt(vx, out=vx)
    sxy /= vx
    sxy[~ok] = 0.0
    return sxy.clip(-1, 1, out=sxy), n


def _within(named: tuple[np.ndarray, ...], rows: tuple[int, int], columns: tuple[int, int], ok: np.ndarray) -> tuple[np.ndarray, ...]:
    a, b, part, number = named
    here = (a >= rows[0]) & (a < rows[1]) & (b >= columns[0]) & (b < columns[1])
    a, b, part, number = a[here] - rows[0], b[here] - columns[0], part[here], number[here]
    real = ok[a, b]
    return a[real], b[real], part[real], number[real]


def _tiles(left: _Band, right: _Band, block: int) -> Iterator[Tile]:
    times = np.unique(np.concatenate([left.t, right.t]))
    high = max(1, min(block, CELLS // len(times)))  # a side of 256 keeps a tile's matrices within a core's cache
    sides = [(k, min(k + high, len(right.name))) for k in range(0, len(right.name), high)]
    named = None
    if left.named is not None:
        of, far, part, number = left.named
        at = np.minimum(np.searchsorted(right.name, far), len(right.name) - 1)
        here = (right.name[at] == far) & ((of <= at) if left is right else True)
        named = of[here], at[here], part[here], number[here]
    held = {s: right.dense(*s, times) for s in sides} if len(right.name) * len(times) <= CELLS else {}
    for i in range(0, len(left.name), block):
        to = min(i + block, len(left.name))
        x, m = left.dense(i, to, times)
        for s in sides:
            if left is right and s[1] <= i + (left.w is None):
                continue
            y, w = held.get(s) or right.dense(*s, times)
            r, n = _tile(x, m, y, w)
            ok = n > 0
            w = None if left.w is None else left.w[i:to, None] * right.w[None, slice(*s)]
            if left is right:
                below = np.arange(i, to)[:, None] - np.arange(*s)[None, :]
                if w is not None:
                    one = below == 0
                    w[one] = (w - left.w[i:to, None])[one] // 2
                    ok &= w > 0
                ok &= below <= (0 if w is not None else -1)
            yield Tile(left.name[i:to], right.name[slice(*s)], r, n, ok, None if left.x is None else left.x[i:to], None if right.x is None else right.x[slice(*s)], w, None if named is None else _within(named, (i, to), s, ok))


def over_pairs(rows: DataFrame, run: Callable[[Iterator[Tile]], Iterator[pd.DataFrame]], schema: str, block: int = BLOCK) -> DataFrame:
    """What run makes of the tiles of each pair of bands of rows (node, t, v and, if there is one, an array x)."""
    s = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("values")).first()
    bands = max(1, min(BANDS, -(-s["n"] // block)), -(-s["values"] // WIDEST))
    p = rows.withColumn("b", F.pmod(F.xxhash64("node"), F.lit(bands)).cast("int"))
    p = p.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    p = p.withColumn("low", F.least("b", "c")).withColumn("high", F.greatest("b", "c"))
    p = p.withColumn("pair", (F.col("high") * (F.col("high") + 1) / 2 + F.col("low")).cast("int")).drop("c")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, same = [], [], True
        for g in batches:
            if len(g):
                same &= bool((g["low"] == g["high"]).all())
                of = g["b"] == g["low"]
                left.append(g[of])
                right.append(g[~of])
        a = pd.concat(left) if left else None
        if a is None or not len(a):
            return
        if same:
            one = _Band(left)
            yield from run(_tiles(one, one, block))
        elif sum(map(len, right)):
            yield from run(_tiles(_Band(left), _Band(right), block))

    return p.repartitionById(bands * (bands + 1) // 2, "pair").mapInPandas(work, schema)


def listed(tiles: Iterator[Tile]) -> Iterator[pd.DataFrame]:
    """(i, j, corr, n) of all pairs, i < j."""
    for t in tiles:
        p, q = np.nonzero(t.ok)
        u, v = t.a[p], t.b[q]
        swap = u > v
        yield pd.DataFrame({"i": np.where(swap, v, u), "j": np.where(swap, u, v), "corr": t.r[p, q], "n": t.n[p, q].astype(np.int64)})


def best_partners(k: int, absolute: bool) -> Callable[[Iterator[Tile]], Iterator[pd.DataFrame]]:
    """(i, j, corr) in both directions: of each node the k partners with the largest correlations, or absolute values;
    ties: the smallest j. Only what reaches a node's present k-th best is looked at."""

    def run(tiles: Iterator[Tile]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        floor: dict = {}
        size = 0

        def first(i, j, r):
            """Each node's k best of these, and so a floor of what may be among its best."""
            key = np.abs(r) if absolute else r
            order = np.lexsort((j, -key, i))
            i, j, r, key = i[order], j[order], r[order], key[order]
            start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
            for x, y in zip(i[place == k - 1].tolist(), key[place == k - 1].tolist(), strict=True):
                floor[x] = max(floor.get(x, y), y)
            return i[place < k], j[place < k], r[place < k]

        def merged():
            nonlocal held, size
            held = [first(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = 0

        for t in tiles:
            key = np.abs(t.r) if absolute else t.r
            for own, other, r, by, ok in ((t.a, t.b, t.r, key, t.ok), (t.b, t.a, t.r.T, key.T, t.ok.T)):
                least = np.array([floor.get(x, -2.0) for x in own.tolist()])
                p, q = np.nonzero((by >= least[:, None]) & ok)
                if len(p):
                    held.append(first(own[p], other[q], r[p, q]))
                    size += len(held[-1][0])
            if size > max(HELD // 16, len(held[0][0]) if held else 0):
                merged()
        if held:
            merged()
            yield pd.DataFrame(dict(zip(("i", "j", "corr"), held[0], strict=True)))

    return run


def largest(k: int, least: float) -> Callable[[Iterator[Tile]], Iterator[pd.DataFrame]]:
    """(i, j, corr): the k pairs of the largest absolute correlations of least or more; ties: the smallest i and j."""

    def run(tiles: Iterator[Tile]) -> Iterator[pd.DataFrame]:
        floor, held = least, []
        for t in tiles:
            p, q = np.nonzero((np.abs(t.r) >= floor) & t.ok)
            if not len(p):
                continue
            u, v = t.a[p], t.b[q]
            swap = u > v
            held.append((np.where(swap, v, u), np.where(swap, u, v), t.r[p, q]))
            i, j, r = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((j, i, -np.abs(r)))[:k]
            held = [(i[order], j[order], r[order])]
            if len(order) == k:
                floor = max(floor, float(np.abs(r[order[-1]])))
        for i, j, r in held:
            yield pd.DataFrame({"i": i, "j": j, "corr": r})

    return run


Parts = Callable[[Tile], np.ndarray]


def sums(part: Parts | None = None, extremes: bool = False) -> Callable[[Iterator[Tile]], Iterator[pd.DataFrame]]:
    """(part, n, s, size, square, low, high): number, sum, sum of absolute values and of squares and, if extremes are
    asked for, least and largest correlation of the pairs of each part, which part() gives as numbers for a tile (None:
    of all, as part 0)."""

    def run(tiles: Iterator[Tile]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for t in tiles:
            r = t.r[t.ok]
            if not len(r):
                continue
            held.append(_summed(np.zeros(len(r), np.int64) if part is None else part(t)[t.ok], r, extremes, None if t.w is None else t.w[t.ok]))
            rows += len(held[-1])
            if rows > HELD:
                held = [_added(held)]
                rows = len(held[0])
        if held:
            yield _added(held)

    return run


def _summed(of: np.ndarray, r: np.ndarray, extremes: bool, w: np.ndarray | None = None) -> pd.DataFrame:
    least = of.min()
    if of.max() - least < 8 * len(of):
        at, names = of - least, None
    else:
        names, at = np.unique(of, return_inverse=True)
    n, size, square = np.bincount(at, w).astype(np.int64), np.abs(r), r * r
    s = r if w is None else r * w
    if w is not None:
        size, square = size * w, square * w
    low, high = np.full(len(n), 2.0), np.full(len(n), -2.0)
    if extremes:
        np.minimum.at(low, at, r)
        np.maximum.at(high, at, r)
    d = pd.DataFrame({"part": np.arange(len(n)) + least if names is None else names, "n": n, "s": np.bincount(at, s), "size": np.bincount(at, size), "square": np.bincount(at, square), "low": low, "high": high})
    return d[n > 0]


def _added(held: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(held).groupby("part", as_index=False).agg({"n": "sum", "s": "sum", "size": "sum", "square": "sum", "low": "min", "high": "max"})


SUMS = "part long, n long, s double, size double, square double, low double, high double"


def totals(rows: DataFrame, part: Parts | None = None, extremes: bool = False) -> DataFrame:
    """sums() of all pairs of rows (stored() or alike()): a row for each part."""
    d = over_pairs(rows, sums(part, extremes), SUMS)
    return d.groupBy("part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("size").alias("size"), F.sum("square").alias("square"), F.min("low").alias("low"), F.max("high").alias("high"))


def quantiles(rows: DataFrame, probs: list[float], part: Parts | None = None, absolute: bool = False, parts: int = 1 << 14, few: int = 1 << 17, rest_part: int | None = None) -> tuple[dict, dict]:
    """({part: quantiles}, {part: (n, sum, sum of absolute values, sum of squares)}) of correlations, or their absolute
    values, of all pairs, interpolated between neighbours as percentile does. Parts should be few.

    A pass counts values by equal ranges; only ranges with wanted ranks go on, until they have few values or a single
    one, which a last pass lists. Each pass goes through the tiles again, so nothing of the size of all pairs is kept.
    Rows are those of stored(), or of alike() where part doesn't tell a class's nodes apart, or of apart(): then parts are
    those named there, and rest_part has all other pairs; they are numbers from 0 to rest_part.
    """

    def value(t: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if t.named is not None:
            a, b, names, number = t.named
            rest = t.w.copy()
            np.subtract.at(rest, (a, b), number)
            ok = t.ok & (rest > 0)
            r = np.concatenate((t.r[ok], t.r[a, b]))
            return (np.abs(r) if absolute else r), np.concatenate((np.full(ok.sum(), rest_part), names)), np.concatenate((rest[ok], number))
        r = t.r[t.ok]
        w = np.ones(len(r), np.int64) if t.w is None else t.w[t.ok]
        if rest_part is not None:
            return (np.abs(r) if absolute else r), np.full(len(r), rest_part), w
        return (np.abs(r) if absolute else r), (np.zeros(len(r), np.int64) if part is None else part(t)[t.ok]), w

    def counted(spans: list[tuple]) -> dict[int, list]:
        """Of each span (part, low, high): rows (place, n, low, high, s, square) of its ranges, in order."""

        def run(tiles: Iterator[Tile]) -> Iterator[pd.DataFrame]:
            n, least, most = np.zeros((len(spans), parts), np.int64), np.full((len(spans), parts), 2.0), np.full((len(spans), parts), -2.0)
            s = np.zeros((len(spans), 3))
            for t in tiles:
                x, of, w = value(t)
                for k, (g, low, high) in enumerate(spans):
                    own = of == g if part is not None or rest_part is not None else slice(None)
                    y, m = x[own], w[own]
                    if (low, high) != (-1.0, 1.0):
                        inside = (y >= low) & (y <= high)
                        y, m = y[inside], m[inside]
                    at = np.minimum(((y - low) / (high - low) * parts).astype(np.int64), parts - 1)
                    n[k] += np.bincount(at, m, minlength=parts).astype(np.int64)
                    np.minimum.at(least[k], at, y)
                    np.maximum.at(most[k], at, y)
                    s[k] += y @ m, np.abs(y) @ m, (y * y) @ m
            k, at = np.nonzero(n)
            one = np.concatenate((k[1:] != k[:-1], [True])) if len(k) else np.zeros(0, bool)  # sums stand in a row of a span
            yield pd.DataFrame({"k": k, "at": at, "n": n[k, at], "low": least[k, at], "high": most[k, at]} | {c: s[k, i] * one for i, c in enumerate(("s", "size", "square"))})

        d = over_pairs(rows, run, "k int, at int, n long, low double, high double, s double, size double, square double")
        d = d.groupBy("k", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"), F.sum("size").alias("size"), F.sum("square").alias("square"))
        out: dict[int, list] = {}
        for r in d.orderBy("k", "at").collect():  # at most as many rows as ranges
            out.setdefault(r["k"], []).append(r)
        return out

    def found(spans: list[tuple]) -> dict[int, list]:
        def run(tiles: Iterator[Tile]) -> Iterator[pd.DataFrame]:
            for t in tiles:
                x, of, w = value(t)
                for k, (g, low, high) in enumerate(spans):
                    inside = (x >= low) & (x <= high) & (of == g)
                    if inside.any():
                        y, at = np.unique(x[inside], return_inverse=True)
                        yield pd.DataFrame({"k": k, "x": y, "n": np.bincount(at, w[inside]).astype(np.int64)})

        out: dict[int, list] = {}
        for r in over_pairs(rows, run, "k int, x double, n long").groupBy("k", "x").agg(F.sum("n").alias("n")).orderBy("k", "x").collect():
            out.setdefault(r["k"], []).append((r["x"], r["n"]))
        return out

    groups = list(range(rest_part + 1)) if rest_part is not None else [0] if part is None else [r["part"] for r in over_pairs(rows, _names(part), "part long").distinct().collect()]
    first = counted([(g, -1.0, 1.0) for g in groups])
    all_of, wanted, todo = {}, {}, []
    for k, ranges in first.items():
        n = sum(r["n"] for r in ranges)
        all_of[groups[k]] = (n, *(sum(r[c] for r in ranges) for c in ("s", "size", "square")))
        at = {i for p in probs for i in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))}
        todo.append((groups[k], 0, sorted(at), ranges))
    while todo:
        spans, rest = [], []
        for g, below, at, ranges in todo:
            for r in ranges:
                inside = [i for i in at if below <= i < below + r["n"]]
                if inside and r["low"] == r["high"]:
                    wanted |= {(g, i): r["low"] for i in inside}
                elif inside:
                    (rest if r["n"] > few else spans).append((g, r["low"], r["high"], below, inside))
                below += r["n"]
        values = found([s[:3] for s in spans]) if spans else {}
        for k, (g, _, _, below, at) in enumerate(spans):
            for x, n in values[k]:
                wanted |= {(g, i): x for i in at if below <= i < below + n}
                below += n
        again = counted([s[:3] for s in rest]) if rest else {}
        todo = [(g, below, at, again[k]) for k, (g, _, _, below, at) in enumerate(rest)]

    def at(g, n: int, p: float) -> float:
        k, f = int(p * (n - 1)), p * (n - 1) - int(p * (n - 1))
        return wanted[g, k] + (wanted[g, min(k + 1, n - 1)] - wanted[g, k]) * f

    return {g: [at(g, s[0], p) for p in probs] for g, s in all_of.items()}, all_of


def _names(part: Parts) -> Callable[[Iterator[Tile]], Iterator[pd.DataFrame]]:
    def run(tiles: Iterator[Tile]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for t in tiles:
            seen |= set(np.unique(part(t)[t.ok]).tolist())
        yield pd.DataFrame({"part": np.array(sorted(seen), np.int64)})

    return run
