"""Graph operators over edge tables (u, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import components, dropped, written as kept


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()


def indexed(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """df with each row's position, from 0, in an order. Rows are dealt by ranges of it, sorted and numbered within
    each, and moved up by the counts of the ranges before, so no task gets all; order should tell rows apart."""
    from pyspark.sql import Window

    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    rows = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()).withColumn("__at", at))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = rows.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return rows.join(F.broadcast(start), "__range").withColumn(name, F.col("__start") + F.col("__at")).drop("__range", "__at", "__n", "__start")


def reindexed(edges: DataFrame) -> DataFrame:
    """Distinct end points with a dense index in their order."""
    return indexed(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), ["node"])


def hops(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, node, hop) of all nodes within most steps of each source along directed edges: a frontier of unseen
    nodes is joined with the edges in each round."""
    seen = front = sources.select(F.col("node").alias("source"), "node", F.lit(0).cast("bigint").alias("hop"))
    for k in range(1, most + 1):
        step = front.select("source", F.col("node").alias("u")).join(edges.select("u", "v"), "u").select("source", F.col("v").alias("node")).distinct()
        front = kept(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hop", F.lit(k).cast("bigint")))
        seen = seen.unionAll(front)
    return seen


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component; a node whose links are to itself alone is one."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    roots = components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("__n"), "root")
    return nodes.join(roots, nodes.node == roots["__n"], "left").select("node", F.coalesce("root", "node").alias("component"))


def distances(edges: DataFrame, sources: DataFrame, few: int = 10_000) -> DataFrame:
    """(source, node, length, hops) of the shortest directed path from each of sources (source) to every node it
    reaches; of paths of one length the one of fewest edges. Lengths must not be negative.

    Paths stay within connected components. Those of at most few edges are grouped, a slice of a component's sources
    with its edges at a time; larger ones relax in rounds until no distance falls any more."""
    every = kept(edges.groupBy(F.col("u").alias("__u"), F.col("v").alias("__v")).agg(F.min("length_m").alias("__m")).where("__u <> __v"))
    start = sources.select("source").where("source IS NOT NULL").distinct()
    own = start.select("source", F.col("source").alias("node"), F.lit(0.0).alias("length"), F.lit(0).alias("hops"))
    label = kept(connected(every.select(F.col("__u").alias("u"), F.col("__v").alias("v"))))
    parts = kept(every.join(label, F.col("__u") == label.node).select("component", "__u", "__v", "__m"))
    start = kept(start.join(label, F.col("source") == label.node).select("component", "source"))
    sized = parts.groupBy("component").agg(F.count("*").alias("edges"))
    # a slice of sources and its edges make at most about a million steps
    slices = F.greatest(F.ceil(F.col("of") * F.col("edges") / 1e6), F.lit(1)).cast("int")
    plan = kept(start.groupBy("component").agg(F.count("*").alias("of")).join(sized, "component").select("component", "edges", slices.alias("slices")))
    small = plan.where(F.col("edges") <= few)
    slice_of = F.pmod(F.xxhash64("source"), F.col("slices")).cast("int")
    dealt = start.join(small, "component").select("component", slice_of.alias("slice"), F.col("source").alias("a"), F.col("source").alias("b"), F.lit(None).cast("double").alias("m"), F.lit(True).alias("start"))
    ways = parts.join(small, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("__u").alias("a"), F.col("__v").alias("b"), F.col("__m").cast("double").alias("m"), F.lit(False).alias("start"))
    kind = sources.schema["source"].dataType.simpleString()
    out = own.unionByName(dealt.unionByName(ways).groupBy("component", "slice").applyInPandas(_slice_distances, f"source {kind}, node {kind}, length double, hops int"))
    large = plan.where(F.col("edges") > few)
    if large.isEmpty():
        return out
    rest = parts.join(large, "component", "left_semi").select("__u", "__v", "__m")
    far = _relaxed(rest, start.join(large, "component", "left_semi").select("source"))
    return out.unionByName(far.where("source <> node"))


def _slice_distances(g):
    """(source, node, length, hops) of what sources (rows of start) reach over the edges (a, b, m) of one component."""
    import heapq

    import pandas as pd

    near, out = {}, []
    way = ~g["start"]
    for a, b, m in zip(g["a"][way].to_list(), g["b"][way].to_list(), g["m"][way].to_list(), strict=True):
        near.setdefault(a, []).append((b, m))
    for s in g["a"][g["start"]].to_list():
        best, left = {s: (0.0, 0)}, [(0.0, 0, s)]
        while left:
            length, hops, a = heapq.heappop(left)
            if (length, hops) > best[a]:
                continue
            for b, m in near.get(a, ()):
                to = (length + m, hops + 1)
                if b not in best or to < best[b]:
                    best[b] = to
                    heapq.heappush(left, (*to, b))
        out += [(s, b, *x) for b, x in best.items() if b != s]
    return pd.DataFrame(out, columns=["source", "node", "length", "hops"])


def _relaxed(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """distances() by rounds of relaxation. No table of a round is sent to the driver: joins merge."""
    spark = steps.sparkSession
    dist = front = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("length"), F.lit(0).alias("hops"))
    now: list[str] = []
    while True:
        step = front.hint("merge").join(steps, F.col("node") == F.col("__u")).select("source", F.col("__v").alias("node"), (F.col("length") + F.col("__m")).alias("length"), (F.col("hops") + 1).alias("hops"))
        step = step.groupBy("source", "node").agg(F.min(F.struct("length", "hops")).alias("x")).select("source", "node", "x.*")
        was = dist.select("source", "node", F.struct("length", "hops").alias("was"))
        before, now = now, []
        front = kept(step.hint("merge").join(was, ["source", "node"], "left").where(F.col("was").isNull() | (F.struct("length", "hops") < F.col("was"))).drop("was"), now)
        if front.isEmpty():
            dropped(spark, now)
            return dist
        dist = kept(dist.unionByName(front).groupBy("source", "node").agg(F.min(F.struct("length", "hops")).alias("x")).select("source", "node", "x.*"), now)
        dropped(spark, before)


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, length, hops) of the shortest directed path of each pair; pairs out of reach are left out."""
    return pairs.join(distances(edges, pairs).withColumnRenamed("node", "target"), ["source", "target"])


def betweenness(edges: DataFrame, sources: DataFrame, most_rows: int = 200_000_000, few: int = 10_000) -> DataFrame:
    """(node, score): sums over sources of the dependencies of unweighted shortest paths. Self-links are ignored; only
    nodes that some source reaches have a row.

    Paths stay within connected components. Those of at most few edges are grouped, a slice of a component's sources
    with its edges at a time. In larger ones levels of all sources are joined with the edges, counting paths, and
    dependencies are summed level by level, from the farthest back; sources go in blocks, so that a block's
    tables have about most_rows rows."""
    every = kept(edges.select(F.col("u").alias("__u"), F.col("v").alias("__v")).where("__u <> __v").distinct())
    label = kept(connected(every.select(F.col("__u").alias("u"), F.col("__v").alias("v"))))
    parts = kept(every.join(label, F.col("__u") == label.node).select("component", "__u", "__v"))
    sized = kept(parts.groupBy("component").agg(F.count("*").alias("edges")))
    small, start = sized.where(F.col("edges") <= few), kept(sources.select("node").groupBy("node").agg(F.count("*").alias("times")).join(label, "node"))
    # a slice of sources and its edges make at most about 10 million steps
    slices = F.greatest(F.ceil(F.col("of") * F.col("edges") / 1e7), F.lit(1)).cast("int")
    plan = start.groupBy("component").agg(F.count("*").alias("of")).join(small, "component").select("component", slices.alias("slices"))
    dealt = start.join(plan, "component").select("component", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"), F.col("node").alias("a"), F.lit(None).cast(edges.schema["v"].dataType).alias("b"), "times")
    ways = parts.join(plan, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("__u").alias("a"), F.col("__v").alias("b"), F.lit(0).cast("long").alias("times"))
    kind = edges.schema["u"].dataType.simpleString()
    grouped = dealt.unionByName(ways).groupBy("component", "slice").applyInPandas(_slice_scores, f"node {kind}, score double")
    large = sized.where(F.col("edges") > few).select("component")
    if large.isEmpty():
        return grouped.groupBy("node").agg(F.sum("score").alias("score"))
    rest = parts.join(large, "component", "left_semi").select(F.col("__u").alias("u"), F.col("__v").alias("v"))
    far = _by_levels(rest, start.join(large, "component", "left_semi").select("node", "times"), most_rows)
    return grouped.unionAll(far).groupBy("node").agg(F.sum("score").alias("score"))


def _slice_scores(g):
    """(node, score) of sources (a, null, times) over edges (a, b) of one component."""
    import pandas as pd

    near, score = {}, {}
    way = g["b"].notna()
    for a, b in zip(g["a"][way].to_list(), g["b"][way].astype(g["a"].dtype).to_list(), strict=True):
        near.setdefault(a, []).append(b)
    for s, times in zip(g["a"][~way].to_list(), g["times"][~way].to_list(), strict=True):
        level, paths, before, order = {s: 0}, {s: 1.0}, {}, [s]
        for a in order:
            for b in near.get(a, ()):
                if b not in level:
                    level[b], paths[b] = level[a] + 1, 0.0
                    order.append(b)
                if level[b] == level[a] + 1:
                    paths[b] += paths[a]
                    before.setdefault(b, []).append(a)
        share = dict.fromkeys(order, 0.0)
        for b in reversed(order[1:]):
            for a in before[b]:
                share[a] += paths[a] / paths[b] * (1 + share[b])
            score[b] = score.get(b, 0.0) + share[b] * times
    return pd.DataFrame({"node": list(score), "score": list(score.values())}, columns=["node", "score"])


def _by_levels(edges: DataFrame, sources: DataFrame, most_rows: int) -> DataFrame:
    steps = kept(edges.select(F.col("u").alias("__u"), F.col("v").alias("__v")))
    nodes = steps.select(F.explode(F.array("__u", "__v")).alias("node")).distinct().count()
    start = kept(sources)
    blocks = -(-start.count() * nodes // most_rows) or 1
    parts = [_dependencies(steps, start.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i)) for i in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _dependencies(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(node, score) of sources start (node, times); a source's own dependency isn't counted."""
    front = start.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths"))
    levels, old = [front], []
    seen = front.select("source", "node")
    while True:
        step = levels[-1].join(steps, F.col("node") == F.col("__u")).groupBy("source", F.col("__v").alias("node")).agg(F.sum("paths").alias("paths"))
        front = kept(step.join(seen, ["source", "node"], "left_anti"), old)
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionAll(front.select("source", "node"))
    share, scores = levels[-1].withColumn("share", F.lit(0.0)), []
    for before in reversed(levels[:-1]):
        scores.append(share)
        to = share.select("source", F.col("node").alias("__v"), ((F.col("share") + 1) / F.col("paths")).alias("x")).join(steps, "__v")
        to = to.groupBy("source", F.col("__u").alias("node")).agg(F.sum("x").alias("x"))
        share = kept(before.join(to, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("x", F.lit(0.0))).alias("share")), old)
    out = share.where("false").select("source", "node", "share")
    for s in scores:
        out = out.unionAll(s.select("source", "node", "share"))
    times = start.select(F.col("node").alias("source"), "times")
    out = kept(out.join(times, "source").groupBy("node").agg(F.sum(F.col("share") * F.col("times")).alias("score")))
    dropped(steps.sparkSession, old)
    return out


def sampled_betweenness(edges: DataFrame, share: float = 0.1, least: int = 100, seed: int = 42) -> DataFrame:
    """(node, score) of the undirected graph, estimated from max(least, share of all) nodes in the order of a seeded
    hash as sources and scaled to all pairs, so scores lie between 0 and 1. Nodes on no path have 0."""
    both = kept(undirected(edges))
    nodes = both.select(F.col("u").alias("node")).distinct()
    n = nodes.count()
    k = min(n, max(least, int(share * n)))
    picked = nodes.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "node")), "node").limit(k)
    score = betweenness(both, picked)
    scale = n / (max(k, 1) * max((n - 1) * (n - 2), 1))
    return nodes.join(score, "node", "left").select("node", (F.coalesce("score", F.lit(0.0)) * scale).alias("score"))


def _merged(u: list, v: list, total: int) -> dict:
    """Greedy modularity of one connected part of a graph of total edges: the two groups whose union gains most are
    joined (ties: the smallest names) while that gains; a node's group is named by its smallest member."""
    import heapq

    near: dict = {}
    for a, b in zip(u, v, strict=True):
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1
    degree, members = {a: len(x) for a, x in near.items()}, {a: [a] for a in near}
    age = dict.fromkeys(near, 0)
    gain = lambda a, b: near[a][b] / total - degree[a] * degree[b] / (2 * total * total)
    heap = [(-gain(a, b), a, b, 0, 0) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        g, a, b, x, y = heapq.heappop(heap)
        if g >= 0:
            break
        if a not in near or b not in near or (age[a], age[b]) != (x, y):
            continue
        for c, w in near.pop(b).items():
            if c != a:
                del near[c][b]
                near[a][c] = near[c][a] = near[a].get(c, 0) + w
        near[a].pop(b)
        degree[a] += degree.pop(b)
        members[a] += members.pop(b)
        age[a] += 1
        for c in near[a]:
            p, q = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(p, q), p, q, age[p], age[q]))
    return {m: a for a, ms in members.items() for m in ms}


def communities(edges: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """(node, community) by greedy modularity, undirected and unweighted; a community is named by its smallest node.
    Joins never cross connected components and a join's gain depends on the rest by the number of edges alone, so each
    component of at most most_edges edges is one task's work; larger ones are joined in rounds by all tasks."""
    import pandas as pd

    e = kept(undirected(edges).where("u < v"))
    total, label = e.count(), connected(e)
    parts = kept(e.join(label, e.u == label.node).select("component", "u", "v"))
    large = kept(parts.groupBy("component").count().where(F.col("count") > most_edges).select("component"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = _merged(g["u"].to_list(), g["v"].to_list(), total)
        return pd.DataFrame({"node": list(out), "community": list(out.values())})

    kind = edges.schema["u"].dataType.simpleString()
    one = parts.join(large, "component", "left_anti").groupBy("component").applyInPandas(run, f"node {kind}, community {kind}")
    if large.isEmpty():
        return one
    return one.unionByName(joined_in_rounds(parts.join(large, "component", "left_semi").select("u", "v"), total))


def joined_in_rounds(links: DataFrame, total: int) -> DataFrame:
    """(node, community) of links (u, v), u < v, of a graph of total ones, by rounds of joins that raise modularity.

    Groups are nodes of a weighted graph. In each round every group names the neighbour whose union with it gains most
    (ties: the smallest). Pairs that name each other are joined. So are groups that name one that names another, or is
    in such a pair, if the union gains even beside all others that ask for it (which a hub of many leaves needs), and
    those that ask go to a group that asks for nothing itself in this round: a hash of group and round deals who asks.
    Rounds end when no union gains; refined() then moves single nodes. Edges, groups and labels are tables;
    nothing meets in one task.
    """
    spark, m = links.sparkSession, float(total)
    w = kept(links.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("w")), now := [])
    ends = w.select(F.explode(F.array("a", "b")).alias("g"))
    size = kept(ends.groupBy("g").agg(F.count("*").cast("double").alias("d")), now)
    label = kept(size.select(F.col("g").alias("node"), F.col("g").alias("community")), now)
    k = 0
    while True:
        d = lambda x: size.select(F.col("g").alias(x), F.col("d").alias(f"d{x}"))  # noqa: B023, E731
        both = w.unionAll(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).join(d("a"), "a").join(d("b"), "b")
        both = both.withColumn("gain", F.col("w") / m - F.col("da") * F.col("db") / (2 * m * m)).where("gain > 0")
        # the least of (-gain, b) is the best gain and its smallest name
        best = both.groupBy("a").agg(F.min(F.struct((-F.col("gain")).alias("less"), "b", "w", "da", "db")).alias("x")).select("a", "x.*")
        best, old = kept(best, step := []), now
        if best.isEmpty():
            dropped(spark, step)
            break
        back = best.select(F.col("a").alias("b"), F.col("b").alias("of"))
        named = best.join(back, "b", "left").withColumn("mutual", F.col("of").eqNullSafe(F.col("a")))
        mutual = named.where("mutual AND a > b").select("a", "b")
        asks = lambda x: F.pmod(F.xxhash64(F.col(x), F.lit(k)), F.lit(2)) == 0  # noqa: B023, E731
        ask = named.where(~F.col("mutual")).where(asks("a") & ~asks("b")).select("a", "b", "w", "da", "db")
        taken = mutual.select(F.explode(F.array("a", "b")).alias("a"))
        ask = ask.join(taken, "a", "left_anti").join(taken.select(F.col("a").alias("b")), "b", "left_anti")
        crowd = ask.groupBy("b").agg(F.sum("da").alias("crowd"))
        ask = ask.join(crowd, "b").where(F.col("w") / m > F.col("da") * (F.col("db") + F.col("crowd") - F.col("da")) / (2 * m * m)).select("a", "b")
        move = kept(mutual.unionByName(ask), step)
        to = lambda x, new: F.coalesce(F.col(new), F.col(x))
        moved = lambda x, new: move.select(F.col("a").alias(x), F.col("b").alias(new))  # noqa: B023, E731
        now = []
        w2 = w.join(moved("a", "a2"), "a", "left").join(moved("b", "b2"), "b", "left").select(to("a", "a2").alias("p"), to("b", "b2").alias("q"), "w").where("p <> q")
        w2 = kept(w2.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("w").alias("w")), now)
        size2 = kept(size.join(moved("g", "g2"), "g", "left").groupBy(to("g", "g2").alias("g")).agg(F.sum("d").alias("d")), now)
        label2 = kept(label.join(moved("community", "c2"), "community", "left").select("node", to("community", "c2").alias("community")), now)
        dropped(spark, old + step)
        w, size, label, k = w2, size2, label2, k + 1
    label = refined(links, label, m)
    least = label.groupBy("community").agg(F.min("node").alias("name"))
    out = kept(label.join(least, "community").select("node", F.col("name").alias("community")))
    dropped(spark, now)
    return out


def refined(links: DataFrame, label: DataFrame, m: float, most_rounds: int = 24) -> DataFrame:
    """label (node, community) after moves of nodes to the neighbouring community that raises modularity most. In each
    round a hash deals a quarter of the nodes that would gain; a round that lowers modularity is taken back and ends it."""
    both = kept(links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), old := [])
    degree = kept(both.groupBy("u").agg(F.count("*").cast("double").alias("d")), old)
    gain = lambda k, own, d, to, of: (k - own) / m - d * (to - of + d) / (2 * m * m)

    def state(label: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        of_v = label.select(F.col("node").alias("v"), F.col("community").alias("c"))
        near = kept(both.join(of_v, "v").groupBy("u", "c").agg(F.count("*").cast("double").alias("k")).join(label.select(F.col("node").alias("u"), F.col("community").alias("own")), "u").join(degree, "u"), old)
        size = kept(label.join(degree, label.node == degree.u).groupBy("community").agg(F.sum("d").alias("size")), old)
        inside = near.where("c = own").agg(F.sum("k")).first()[0] or 0.0
        return near, size, inside / (2 * m) - (size.agg(F.sum(F.col("size") * F.col("size"))).first()[0] or 0.0) / (4 * m * m)

    near, size, score = state(label)
    for r in range(most_rounds):
        own = near.where("c = own").select("u", F.col("k").alias("k_own"))
        of = lambda c, n: size.select(F.col("community").alias(c), F.col("size").alias(n))  # noqa: B023, E731
        x = near.where("c <> own").join(own, "u", "left").join(of("c", "to"), "c").join(of("own", "of"), "own")
        x = x.withColumn("gain", gain(F.col("k"), F.coalesce("k_own", F.lit(0.0)), F.col("d"), F.col("to"), F.col("of"))).where("gain > 1e-12")
        best = kept(x.groupBy("u").agg(F.min(F.struct((-F.col("gain")).alias("less"), "c")).alias("x")).select("u", F.col("x.c").alias("new")), old)
        if best.isEmpty():
            break
        move = best.where(F.pmod(F.xxhash64("u", F.lit(r)), F.lit(4)) == 0)
        moved = kept(label.join(move, label.node == move.u, "left").select("node", F.coalesce("new", "community").alias("community")), old)
        near, size, now = state(moved)
        if now < score - 1e-12:
            break
        label, score = moved, now
    out = kept(label)
    dropped(links.sparkSession, old)
    return out


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of labels (node, community)."""
    e = undirected(edges)
    a, b = labels.select(F.col("node").alias("u"), F.col("community").alias("cu")), labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    by = e.join(a, "u").join(b, "v").groupBy("cu").agg(F.count("*").alias("k"), F.count_if(F.col("cu") == F.col("cv")).alias("own"))
    s = by.agg(F.sum("k").alias("m2"), F.sum("own").alias("own"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"))
    return s.select((F.try_divide("own", "m2") - F.try_divide(F.col("kk"), F.col("m2").cast("double") * F.col("m2"))).alias("modularity"))


def zones(edges: DataFrame, places: DataFrame, links: DataFrame, seeds: DataFrame, radius: float, near: tuple[float, float], least: float, latest: int, most: int) -> DataFrame:
    """(seed, node, score, base) of the zone around each seed. Base: nodes within two steps and the radius (metres) of
    the seed, itself included. Added: for each base node, nodes within two steps and a distance in near whose link
    (i, j, weight, tau) weighs least or more with |tau| at most latest. Base nodes all stay; added ones, by their
    largest weight and then name, as long as the zone has no more than most nodes. places are (node, lat, lon)."""
    from pyspark.sql import Window

    from ..functions.measures import haversine

    def around(of: DataFrame) -> DataFrame:
        """(a, b, metres): b within two steps of a, both ways along edges."""
        both = undirected(edges)
        one = of.join(both, of.a == both.u).select("a", F.col("v").alias("b"))
        two = one.join(both, one.b == both.u).select("a", F.col("v").alias("b"))
        p = lambda x: places.select(F.col("node").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
        met = one.union(two).where("a <> b").distinct().join(p("a"), "a").join(p("b"), "b")
        return met.select("a", "b", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("metres"))

    start = seeds.select(F.col("node").alias("a")).distinct()
    base = kept(around(start).where(F.col("metres") <= radius).select(F.col("a").alias("seed"), F.col("b").alias("node")).union(start.select("a", "a")).distinct())
    found = around(base.select(F.col("node").alias("a")).distinct()).where(F.col("metres").between(*near))
    found = found.join(links, (F.col("a") == links.i) & (F.col("b") == links.j)).where((F.col("weight") >= least) & (F.abs("tau") <= latest))
    more = base.join(found, base.node == found.a).select("seed", F.col("b").alias("node"), "weight").groupBy("seed", "node").agg(F.max("weight").alias("score"))
    more = more.join(base, ["seed", "node"], "left_anti")
    sized = base.groupBy("seed").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "node"))
    more = more.withColumn("place", place).join(sized, "seed").where(F.col("place") <= most - F.col("n"))
    return base.select("seed", "node", F.lit(None).cast("double").alias("score"), F.lit(True).alias("base")).unionAll(more.select("seed", "node", "score", F.lit(False)))
