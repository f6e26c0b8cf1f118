"""Eigenvectors of sparse symmetric matrices whose vectors are tables, and what is made of them.

Locally optimal block iteration: the lowest vectors are sought in the span of the present ones, their preconditioned
residuals and the last directions. A round is one product of the matrix with a block of vectors, an equi-join with the
edges and a sum by node, and one pass that adds up the small Gram matrices the driver solves; no vector and no
matrix is ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import dropped, written
from . import graphs, matrices, tiles

#: Vectors beyond those that are asked for, which speed the others up; more where a product costs much, whatever it has.
GUARD, MANY = 4, 16
PARTS = ("x", "w", "p")


def _product(t: DataFrame, links: DataFrame | Callable[[DataFrame, int], DataFrame], column: str, n: int) -> DataFrame:
    """(node, y): the matrix times the block column of t; the matrix is t's diagonal d less links (u, v, weight)."""
    if isinstance(links, DataFrame):
        far = links.join(t.select(F.col("node").alias("v"), F.col(column).alias("__y")), "v")
        sums = far.groupBy("u").agg(*[F.sum(F.col("weight") * F.col("__y")[i]).alias(f"s{i}") for i in range(n)])
    else:
        sums = links(t.select("node", F.col(column).alias("x")), n).select("u", *[F.col("s")[i].alias(f"s{i}") for i in range(n)])
    y = F.array(*[F.col("d") * F.col(column)[i] - F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n)])
    return t.join(sums, F.col("node") == F.col("u"), "left").select("node", y.alias("y"))


def _span(b: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's vectors side by side, and the matrix times them."""
    wide = lambda c: np.array(b[c].tolist(), float).reshape(len(b), n)
    return np.hstack([wide(c) for c in PARTS]), np.hstack([wide("l" + c) for c in PARTS])


def _grams(t: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner products of all vectors, with the matrix between, and the squared residuals of the present ones."""
    m = 3 * n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * m * m + n)
        for b in batches:
            s, ls = _span(b, n)
            r = s[:, n : 2 * n] * b["scale"].to_numpy()[:, None]
            total += np.concatenate([(s.T @ s).ravel(), (s.T @ ls).ravel(), (r * r).sum(0)])
        yield pd.DataFrame({"k": np.arange(len(total), dtype=np.int32), "s": total})

    got = t.mapInPandas(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas().sort_values("k")["s"].to_numpy()
    h = got[m * m : 2 * m * m].reshape(m, m)
    return got[: m * m].reshape(m, m), (h + h.T) / 2, got[2 * m * m :]


def _lowest(g: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n lowest values in a span and their coefficients; directions that the span has twice are left out."""
    size = np.sqrt(np.maximum(np.diag(g), 1e-300))
    keep = np.diag(g) > 1e-28
    size = np.where(keep, size, 1.0)
    g, h = g / size[:, None] / size, h / size[:, None] / size
    g[~keep], g[:, ~keep], h[~keep], h[:, ~keep] = 0, 0, 0, 0
    a, q = np.linalg.eigh(g)
    q = q[:, a > 1e-10 * a.max()] / np.sqrt(a[a > 1e-10 * a.max()])
    v, c = np.linalg.eigh(q.T @ h @ q)
    return v[:n], (q @ c[:, :n]) / size[:, None]


def lowest(diagonal: DataFrame, links: DataFrame | Callable[[DataFrame, int], DataFrame], k: int, tolerance: float = 1e-6, most_rounds: int = 200, keep: list[str] | None = None, guard: int = GUARD) -> tuple[DataFrame, np.ndarray]:
    """(node, vector), vector the k cells that a node has in the eigenvectors of the lowest values, and these values.

    The matrix is diagonal (node, d) less links (u, v, weight), which hold both directions, or less what links(t, n)
    makes of the n cells x of each row of t (node, x): (u, s), s the links times x. Rounds go on until every
    residual is below tolerance times the largest of 1 and the values; not getting there is an ArithmeticError. There
    must be several times as many nodes as vectors.
    """
    spark, keep, n = diagonal.sparkSession, [] if keep is None else keep, k + guard
    old: list[str] = []
    if isinstance(links, DataFrame):
        links = written(links.select("u", "v", "weight"), old)
    start = F.array(*[F.xxhash64("node", F.lit(i)).bitwiseAND((1 << 52) - 1) / float(1 << 52) - 0.5 for i in range(n)])
    zero = F.array(*[F.lit(0.0)] * n)
    t = written(diagonal.select("node", F.col("d").cast("double").alias("d"), start.alias("x"), zero.alias("w"), zero.alias("lw"), zero.alias("p"), zero.alias("lp"), F.lit(1.0).alias("scale")), now := [])
    t2 = written(t.join(_product(t, links, "x", n).withColumnRenamed("y", "lx"), "node"), now)
    kind = diagonal.schema["node"].dataType.simpleString()
    shape = f"node {kind}, d double, x array<double>, lx array<double>, w array<double>, p array<double>, lp array<double>, scale double"

    def moved(c: np.ndarray, values: np.ndarray):
        old_x = c.copy()
        old_x[:n] = 0  # the direction is what the present vectors have no part in

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                s, ls = _span(b, n)
                x, lx = s @ c, ls @ c
                scale = np.maximum(np.abs(b["d"].to_numpy()), 1e-3)
                w = (lx - x * values) / scale[:, None]
                yield pd.DataFrame({"node": b["node"], "d": b["d"], "x": list(x), "lx": list(lx), "w": list(w), "p": list(s @ old_x), "lp": list(ls @ old_x), "scale": scale})

        return run

    for r in range(most_rounds):
        g, h, residual = _grams(t2, n)
        if r > 1 and np.sqrt(residual[:k]).max() <= tolerance * max(1.0, abs(values[:k]).max()):
            break
        values, c = _lowest(g, h, n)
        before, now = now, []
        t = written(t2.mapInPandas(moved(c, values), shape), now)
        t2 = written(t.join(_product(t, links, "w", n).withColumnRenamed("y", "lw"), "node"), now)
        dropped(spark, before)
    else:
        raise ArithmeticError(f"residuals of {np.sqrt(residual[:k])} after {most_rounds} rounds")
    out = written(t2.select("node", F.slice("x", 1, k).alias("vector")), keep)
    dropped(spark, old + now)
    return out, values[:k]


def laplacian_vectors(edges: DataFrame, k: int, most: int = matrices.MOST_NODES) -> DataFrame:
    """(node, place): cells of the eigenvectors of the k smallest eigenvalues of D - A of an undirected graph, whose
    first cell that isn't about zero is positive. Up to most nodes they are those of a dense matrix, beyond of tables."""
    e = graphs.undirected(edges)
    nodes = e.select(F.col("u").alias("node")).distinct()
    if nodes.count() > most:
        parts = _parts(e, k)
        if parts is not None:
            return parts
        degree = e.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("d"))
        v, _ = lowest(degree, e.withColumn("weight", F.lit(1.0)), k)
        first = v.agg(*[F.min_by(F.col("vector")[i], F.when(F.abs(F.col("vector")[i]) > 1e-9, F.col("node"))).alias(f"f{i}") for i in range(k)]).first()
        sign: list[Column] = [F.lit(-1.0 if (first[i] or 0) < 0 else 1.0) for i in range(k)]
        return v.select("node", F.array(*[F.col("vector")[i] * s for i, s in enumerate(sign)]).alias("place"))
    p = e.select(F.lit("all").alias("session"), F.lit(0).cast("bigint").alias("t"), F.col("u").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("value"))
    names = matrices.node_list(p, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b["m"]:
                yield pd.DataFrame({"node": names, "place": list(matrices.laplacian_vectors(np.asarray(m).reshape(len(names), -1), k))})

    kind = edges.schema["u"].dataType.simpleString()
    return matrices.snapshots(p, names, mirrored=False, diagonal=0.0).mapInPandas(run, f"node {kind}, place array<double>")


def _parts(e: DataFrame, k: int) -> DataFrame | None:
    """laplacian_vectors() of a graph of k connected components or more, whose k smallest eigenvalues are all zero: the
    vectors that are even on one component and zero elsewhere, for the k with the smallest nodes. None if it has fewer
    components. No iteration can tell these values apart or needs to."""
    label = written(graphs.connected(e))
    size = label.groupBy("component").agg(F.count("*").alias("n")).orderBy("component").limit(k).collect()
    if len(size) < k:
        return None
    return label.select("node", F.array(*[F.when(F.col("component") == r["component"], F.lit(1.0 / float(np.sqrt(r["n"])))).otherwise(0.0) for r in size]).alias("place"))


def regions(pairs: DataFrame, k: int, most_rounds: int = 50) -> DataFrame:
    """(node, region): spectral clusters of pairs (i, j, corr), i < j, by absolute values as affinities, as
    matrices.regions() finds them in a dense matrix: rows of the k leading eigenvectors of the normalised affinity,
    k-means from far-apart starts, labels that count up by the smallest member."""
    both = pairs.select(F.col("i").alias("u"), F.col("j").alias("v"), F.abs("corr").alias("a"))
    both = both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "a"))
    size = both.groupBy(F.col("u").alias("node")).agg(F.sqrt(F.greatest(F.sum("a"), F.lit(1e-12))).alias("s"))
    of = lambda x: size.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"))
    links = both.join(of("u"), "u").join(of("v"), "v").select("u", "v", (F.col("a") / (F.col("su") * F.col("sv"))).alias("weight"))
    return _clustered(size.select("node", F.lit(1.0).alias("d")), links, k, most_rounds)


def _clustered(diagonal: DataFrame, links: DataFrame | Callable[[DataFrame, int], DataFrame], k: int, most_rounds: int, guard: int = GUARD) -> DataFrame:
    """(node, region) by the vectors of diagonal less links."""
    v, _ = lowest(diagonal, links, k, keep=(old := []), guard=guard)
    norm = F.greatest(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    x = written(v.select("node", F.transform("vector", lambda c: c / norm).alias("x")), old)
    away = lambda c: F.aggregate(F.zip_with("x", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    centres = [list(map(float, x.agg(F.min_by("x", "node")).first()[0]))]
    while len(centres) < k:
        far = x.agg(F.max_by("x", F.struct(F.least(*[away(c) for c in centres], F.lit(float("inf"))), -F.col("node")))).first()[0]
        centres.append(list(map(float, far)))

    def nearest(centres: list) -> Column:
        return F.array_min(F.array(*[F.struct(away(c).alias("d"), F.lit(i).alias("q")) for i, c in enumerate(centres)]))["q"]

    for _ in range(most_rounds):
        sums = {r["q"]: r for r in x.groupBy(nearest(centres).alias("q")).agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)]).collect()}
        new = [[sums[q][f"m{i}"] for i in range(k)] if q in sums else c for q, c in enumerate(centres)]
        same, centres = np.allclose(new, centres), new
        if same:
            break
    label = x.select("node", nearest(centres).alias("q"))
    names = [r["q"] for r in label.groupBy("q").agg(F.min("node").alias("first")).orderBy("first").collect()]
    number = F.array_position(F.array(*map(F.lit, names)), F.col("q")) - 1
    out = written(label.select("node", number.cast("bigint").alias("region")))
    dropped(diagonal.sparkSession, old)
    return out


def _strengths(rows: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """(u, s): absolute correlations of the nodes of rows (tiles.stored()) times the n cells of x (node, x). Correlations
    are worked out tile by tile in each product, so that no table holds them."""
    kind = rows.schema["node"].dataType.simpleString()

    def run(batch: Iterator[tiles.Tile]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for t in batch:
            r = np.where(t.ok, np.abs(t.r), 0.0)
            for names, y in ((t.a, r @ t.y), (t.b, r.T @ t.x)):
                known = sums.setdefault((names[0], len(names)), (names, np.zeros(y.shape)))
                known[1][:] += y
        for names, y in sums.values():
            yield pd.DataFrame({"u": names, "s": list(y)})

    part = tiles.over_pairs(rows.join(x, "node"), run, f"u {kind}, s array<double>")
    return part.groupBy("u").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(n)]).alias("s"))


def _shared_strengths(classes: DataFrame, of: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """_strengths() of nodes of which those with equal series are one class: classes (node, t, v), named by its smallest
    node, and of (node, class, own), own the correlation with a node of the same class. A class's cells are added up,
    and what its nodes are times the others of their class comes to the sum of the class without their own cells."""
    both = written(of.join(x, "node"), old := [])
    sums = both.groupBy(F.col("class").alias("node")).agg(F.array(*[F.sum(F.col("x")[i]) for i in range(n)]).alias("x"))
    sums = written(sums, old)
    far = _strengths(classes.select("node", "t", "v"), sums, n).withColumnRenamed("s", "far")
    far = sums.join(far, F.col("node") == F.col("u"), "left").select(F.col("node").alias("class"), F.col("x").alias("all"), "far")
    s = F.array(*[F.coalesce(F.col("far")[i], F.lit(0.0)) + F.col("own") * (F.col("all")[i] - F.col("x")[i]) for i in range(n)])
    out = written(both.join(far, "class").select(F.col("node").alias("u"), s.alias("s")))
    dropped(x.sparkSession, old)
    return out


def correlated_regions(panel: DataFrame, node: str, time: str, value: str, k: int, most: int = matrices.MOST_NODES, most_rounds: int = 50) -> DataFrame:
    """clusters() of the correlations of all pairs of nodes. Beyond most nodes they are not stored but worked out again in
    each product with vectors, once for each two distinct series."""
    rows = tiles.stored(panel, node, time, value)
    count = rows.count()
    if count <= most:
        kind = rows.schema["node"].dataType.simpleString()
        return clusters(tiles.over_pairs(rows, tiles.listed, f"i {kind}, j {kind}, corr double, n bigint"), k, most)
    classes = tiles.alike(rows, old := [])
    of = written(rows.join(classes.select("t", "v", F.col("node").alias("class")), ["t", "v"]).select("node", "class", tiles.with_itself("v").alias("own")), old)
    sums = _shared_strengths(classes, of, of.select("node", F.array(F.lit(1.0)).alias("x")), 1)
    size = written(sums.select(F.col("u").alias("node"), F.sqrt(F.greatest(F.col("s")[0], F.lit(1e-12))).alias("size")), old)

    def product(t: DataFrame, n: int) -> DataFrame:
        x = t.join(size, "node").select("node", F.transform("x", lambda c: c / F.col("size")).alias("x"))
        return _shared_strengths(classes, of, x, n).join(size, F.col("u") == F.col("node")).select("u", F.transform("s", lambda c: c / F.col("size")).alias("s"))

    guard = max(GUARD, min(MANY, count // 8 - k))
    out = _clustered(size.select("node", F.lit(1.0).alias("d")), product, k, most_rounds, guard)
    dropped(panel.sparkSession, old)
    return out


def clusters(pairs: DataFrame, k: int, most: int = matrices.MOST_NODES) -> DataFrame:
    """(node, region) of pairs (i, j, corr): those of a dense matrix up to most nodes, beyond of tables."""
    pairs = graphs.kept(pairs.select("i", "j", "corr"))
    if pairs.select(F.explode(F.array("i", "j")).alias("node")).distinct().count() > most:
        return regions(pairs, k)
    p = pairs.select(F.lit("all").alias("session"), F.lit(0).cast("bigint").alias("t"), "i", "j", F.col("corr").alias("value"))
    names = matrices.node_list(p, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b["m"]:
                yield pd.DataFrame({"node": names, "region": matrices.regions(np.asarray(m).reshape(len(names), -1), k)})

    return matrices.snapshots(p, names).mapInPandas(run, f"node {pairs.schema['i'].dataType.simpleString()}, region bigint")
