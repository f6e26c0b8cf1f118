"""Queries of forecasting models, projections, communities and zones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import forecast, graphs, matrices, series, spectral
from ..sources import stores
from .prepare import DIST
from .relations import ROLL, roll
from .views import EDGES, OBS, TYPES, edges, obs, panel, query, r6, table, types

HORIZONS = [1, 3, 6, 9]


def week(rows):
    """Weeks are sessions and t counts days since 1970."""
    return rows.select(F.date_trunc("week", "date").cast("date").cast("string").alias("session"), F.datediff("date", F.lit("1970-01-01").cast("date")).cast("bigint").alias("t"), "i", "j", F.col("corr").alias("value"))


def directed(spark, d):
    """Rolling correlations of each node's value with another's of the day before; both directions."""
    a = types(spark, d)
    before = a.withColumn("y", F.lag("v").over(Window.partitionBy("node").orderBy("date"))).where("y is not null")
    p = before.select(F.col("node").alias("j"), "date", "y").join(a.select(F.col("node").alias("i"), "date", F.col("v").alias("x")), "date").where("i <> j")
    w = series.last_rows(["i", "j"], ["date"], 10)
    p = p.withColumn("n", F.count("*").over(w)).withColumn("corr", series.guarded_corr(F.col("x"), F.col("y"), w))
    return week(p.where("n = 10"))


def undirected_snapshots(spark, d):
    r = week(roll(spark, d))
    nodes = matrices.node_list(r)
    return matrices.snapshots(r, nodes), nodes


def directed_snapshots(spark, d):
    g = directed(spark, d)
    nodes = matrices.node_list(g)
    return matrices.snapshots(g, nodes, mirrored=False, diagonal=0.0), nodes


def values(spark, d, nodes):
    """(session, t, x): each day's values in the order of nodes, 0 where missing."""
    at = F.array(*[F.lit(n) for n in nodes])
    x = types(spark, d).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("node", "v"))).alias("of"))
    return x.select(F.date_trunc("week", "date").cast("date").cast("string").alias("session"), F.datediff("date", F.lit("1970-01-01").cast("date")).cast("bigint").alias("t"), F.transform(at, lambda n: F.coalesce(F.try_element_at("of", n), F.lit(0.0))).alias("x"))


DIMS = OBS + ", dims AS (SELECT 'speed' AS dim, frc AS node, date, AVG(speed) AS v FROM obs GROUP BY 2, 3 UNION ALL SELECT 'samples', frc, date, CAST(SUM(sample_size) AS DOUBLE) FROM obs GROUP BY 2, 3 UNION ALL SELECT 'constant', frc, date, 1.0::DOUBLE FROM obs GROUP BY 2, 3)"


@query("per_dim_corr", f"WITH {DIMS}, ok AS (SELECT dim FROM (SELECT dim, node, STDDEV_POP(v) AS s FROM dims GROUP BY 1, 2) GROUP BY 1 HAVING MIN(s) >= 1e-8), c AS (SELECT dim, a.node AS i, b.node AS j, COVAR_POP(a.v, b.v) / (STDDEV_POP(a.v) * STDDEV_POP(b.v)) AS c FROM dims a JOIN dims b USING (dim, date) SEMI JOIN ok USING (dim) WHERE a.node < b.node GROUP BY 1, 2, 3) SELECT i, j, ROUND(AVG(c), 6) + 0.0 AS corr FROM c GROUP BY 1, 2")
def per_dim_corr(spark, d):
    """Correlation of each dimension, averaged over those in which no node is constant."""
    o = obs(spark, d).groupBy(F.col("frc").alias("node"), "date").agg(F.avg("speed").alias("speed"), F.sum("sample_size").cast("double").alias("samples"), F.lit(1.0).alias("constant"))
    dims = o.unpivot(["node", "date"], ["speed", "samples", "constant"], "dim", "v")
    ok = dims.groupBy("dim", "node").agg(F.stddev_pop("v").alias("s")).groupBy("dim").agg(F.min("s").alias("s")).where("s >= 1e-8")
    dims = dims.join(ok, "dim", "left_semi")
    b = dims.select("dim", "date", F.col("node").alias("j"), F.col("v").alias("y"))
    c = dims.join(b, ["dim", "date"]).where("node < j").groupBy("dim", F.col("node").alias("i"), "j").agg(series.guarded_corr(F.col("v"), F.col("y")).alias("c"))
    return c.groupBy("i", "j").agg(r6(F.avg("c")).alias("corr"))


@query("feature_select", f"WITH {OBS}, n AS (SELECT COUNT(DISTINCT segment_id) AS segment_id, COUNT(DISTINCT mins) AS mins, COUNT(DISTINCT slot) AS slot, COUNT(DISTINCT speed) AS speed, COUNT(DISTINCT sample_size) AS sample_size, 1 AS one FROM obs) SELECT feature, CAST(n AS BIGINT) AS n FROM (UNPIVOT n ON segment_id, mins, slot, speed, sample_size, one INTO NAME feature VALUE n) WHERE n > 1")
def feature_select(spark, d):
    """Numeric columns with more than one value."""
    o = obs(spark, d).drop("event_id").withColumn("one", F.lit(1))
    numeric = [f.name for f in o.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")]
    n = o.agg(*[F.count_distinct(c).alias(c) for c in numeric])
    return n.unpivot([], numeric, "feature", "n").where("n > 1")


@query("sample_pairs", f"WITH {TYPES}, p AS (SELECT a.node AS i, b.node AS j, a.date FROM types a JOIN types b ON a.date = b.date AND a.node < b.node) SELECT i, j, date FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY date ORDER BY md5(i || ':' || j || ':' || CAST(date AS VARCHAR) || ':42'), i, j) <= 3")
def sample_pairs(spark, d):
    """Three pairs of each day in the order of a seeded hash: repeatable and independent of partitions."""
    p = series.pairs(types(spark, d), "node", "date", "v").withColumn("h", F.md5(F.concat_ws(":", "i", "j", F.col("date").cast("string"), F.lit("42"))))
    return series.ranked(p, ["date"], ["h", "i", "j"], 3).select("i", "j", "date")


@query("matrix_bundle", f"WITH {TYPES}, {ROLL} SELECT i, j, CAST(date_diff('day', DATE '1970-01-01', date) AS BIGINT) AS t, ROUND(corr, 6) + 0.0 AS corr FROM roll")
def matrix_bundle(spark, d):
    """Rolling correlations stored as matrices and read back."""
    snaps, nodes = undirected_snapshots(spark, d)
    back = stores.unbundled(graphs.kept(stores.matrix_bundle(snaps, "double")))
    return matrices.long_rows(back, nodes).select("i", "j", "t", r6("value").alias("corr"))


@query("nearest_corr", None)
def nearest_corr(spark, d):
    snaps, nodes = undirected_snapshots(spark, d)
    return matrices.long_rows(matrices.mapped(snaps, matrices.nearest_correlation, len(nodes)), nodes)


@query("pair_factors", None)
def pair_factors(spark, d):
    r = week(roll(spark, d)).select("t", "i", "j", "value")
    return forecast.factor_forecast(forecast.pair_factors(r), r, HORIZONS)


@query("symmetric_factors", None)
def symmetric_factors(spark, d):
    """Forecast relations of the symmetric factorisation, times the present values."""
    snaps, nodes = undirected_snapshots(spark, d)
    bases = forecast.symmetric_bases(snaps, len(nodes))
    z = forecast.compressed(snaps, bases)
    standard, mean, std = forecast.standardised(z)
    c, phi = forecast.ridge_var(standard, len(mean))
    return forecast.forecast_actions(z, values(spark, d, nodes), bases, mean, std, c, forecast.stable(phi), HORIZONS)


def directed_latents(spark, d):
    snaps, nodes = directed_snapshots(spark, d)
    bases = forecast.directed_bases(snaps, len(nodes))
    return forecast.compressed(snaps, bases), bases, nodes


@query("directed_factors", None)
def directed_factors(spark, d):
    """Relations three steps ahead by VAR and by matrix autoregression of the latents."""
    z, bases, nodes = directed_latents(spark, d)
    p, q = bases.u.shape[1], bases.v.shape[1]
    c, phi = forecast.ridge_var(z, p * q)
    phi = forecast.stable(phi)
    a, b = forecast.matrix_autoregression(z, p, q)
    power = np.linalg.matrix_power

    def run(f):
        def batches(xs):
            for x in xs:
                yield pd.DataFrame({"session": x["session"], "t": x["t"], "m": [forecast.restored(f(np.asarray(v)), bases).ravel() for v in x["z"]]})

        return matrices.long_rows(z.mapInPandas(batches, matrices.SNAPSHOT), nodes, upper=False)

    var = run(lambda v: forecast.ahead(c, phi, v, 3)).withColumn("model", F.lit("var"))
    return var.unionByName(run(lambda v: power(a, 3) @ v.reshape(p, q) @ power(b, 3).T).withColumn("model", F.lit("mar")))


@query("time_varying", None)
def time_varying(spark, d):
    """Coefficients of each node's next value by all present ones, updated along each week."""
    nodes = [r[0] for r in types(spark, d).select("node").distinct().orderBy("node").collect()]
    z, mean, _ = forecast.standardised(values(spark, d, nodes).select("session", "t", F.col("x").alias("z")))
    c, phi = forecast.ridge_var(z, len(mean))
    return forecast.time_varying(z, c, phi)


@query("target_regression", None)
def target_regression(spark, d):
    snaps, nodes = directed_snapshots(spark, d)
    n, beta = len(nodes), forecast.target_regression(snaps, len(nodes))
    return matrices.long_rows(matrices.mapped(snaps, lambda g: forecast.target_forecast(g, beta, 3), n), nodes, upper=False)


@query("elastic_net", None)
def elastic_net(spark, d):
    """Weights of each horizon's values by present values and the relation's action on them."""
    snaps, nodes = undirected_snapshots(spark, d)
    n, x = len(nodes), values(spark, d, nodes)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    acted = snaps.select("t", "m").join(x.select("t", "x"), "t").withColumn("rx", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: dot(F.slice("m", k * n + 1, n), "x")))
    acted, out = graphs.kept(acted), []
    for h in HORIZONS:
        rows = acted.join(x.select((F.col("t") - h).alias("t"), F.col("x").alias("y")), "t").select(F.concat("x", "rx").alias("x"), "y")
        c, w = forecast.elastic_net(rows, 2 * n, n)
        out += [(h, nodes[j], "constant", float(c[j])) for j in range(n)]
        out += [(h, nodes[j], f"{'own' if k < n else 'related'}:{nodes[k % n]}", float(w[k, j])) for k in range(2 * n) for j in range(n)]
    return spark.createDataFrame(out, "h bigint, node string, feature string, weight double")


@query("arma", None)
def arma(spark, d):
    return forecast.arma_forecast(types(spark, d), "node", "date", "v")


@query("sampled_betweenness", None)
def sampled_betweenness(spark, d):
    return graphs.sampled_betweenness(edges(spark, d))


@query("communities", None)
def communities(spark, d):
    return graphs.communities(edges(spark, d))


@query("regions", None)
def regions(spark, d):
    """Five spectral clusters of all nodes by their correlations."""
    return spectral.correlated_regions(panel(spark, d, series.steady_mean), "node", "date", "speed", 5)


@query("laplacian_vectors", None)
def laplacian_vectors(spark, d):
    """Three eigenvectors of the graph of all road nodes."""
    return spectral.laplacian_vectors(edges(spark, d), 3)


LINKS = "links AS (SELECT p_partkey % (SELECT COUNT(*) FROM supplier) AS i, p_size % (SELECT COUNT(*) FROM supplier) AS j, MAX(p_retailprice) AS weight, CAST(MIN(p_size) % 7 AS BIGINT) AS tau FROM part GROUP BY 1, 2)"


@query(
    "zones",
    f"WITH {EDGES}, {LINKS}, ways AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),"
    " around AS (SELECT u AS a, v AS b FROM ways UNION SELECT x.u, y.v FROM ways x JOIN ways y ON x.v = y.u WHERE x.u <> y.v),"
    f" met AS (SELECT a.u AS a, b.u AS b, {DIST} AS metres FROM around r JOIN edges a ON a.u = r.a JOIN edges b ON b.u = r.b),"
    " base AS (SELECT a AS seed, b AS node FROM met WHERE metres <= 4000 UNION SELECT u, u FROM edges),"
    " more AS (SELECT seed, b AS node, MAX(weight) AS score FROM base JOIN met ON base.node = met.a JOIN links ON i = met.a AND j = met.b WHERE metres BETWEEN 50 AND 6000 AND weight >= 900 AND ABS(tau) <= 6 GROUP BY 1, 2),"
    " added AS (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY m.seed ORDER BY score DESC, m.node) AS place FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.seed = m.seed AND b.node = m.node))"
    " SELECT seed, node, CAST(NULL AS DOUBLE) AS score, TRUE AS base FROM base UNION ALL SELECT a.seed, a.node, score, FALSE FROM added a JOIN (SELECT seed, COUNT(*) AS n FROM base GROUP BY 1) s ON s.seed = a.seed WHERE place <= 12 - n",
)
def zones(spark, d):
    e, s = edges(spark, d), table(spark, d, "supplier").count()
    links = table(spark, d, "part").groupBy((F.col("p_partkey") % s).alias("i"), (F.col("p_size") % s).cast("bigint").alias("j")).agg(F.max("p_retailprice").alias("weight"), (F.min("p_size") % 7).cast("bigint").alias("tau"))
    return graphs.zones(e, e.select(F.col("u").alias("node"), "lat", "lon"), links, e.select(F.col("u").alias("node")), 4000.0, (50.0, 6000.0), 900.0, 6, 12)
