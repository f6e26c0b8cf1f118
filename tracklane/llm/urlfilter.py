"""URL filters: allow and block rules first, gradient-boosted trees on lexical features for the rest.

Rules label the URLs that they fit; the trees are trained on a bounded sample of those. Features: lengths, depth,
digit ratio, entropy, parameter counts, and suffix statistics, i.e. the share of allowed URLs among all labelled ones
with the same host suffix (counted over the whole table, in hash buckets, so that their number is bounded).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, plain

#: Labelled URLs that the trees are fitted on, and hash buckets of suffix statistics: both are bounds.
SAMPLE, BUCKETS = 20_000, 4096
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "params", "hyphens", "fragment", "suffix1", "suffix2")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them; both empty for null or where there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and its verdict, else null."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.unique(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), return_counts=True)[1]
    return float(-(n / n.sum() * np.log2(n / n.sum())).sum())


def lexical(url: pd.Series, host: pd.Series, path: pd.Series, one: pd.Series, two: pd.Series, shares: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each URL."""
    url = url.fillna("")
    query = url.str.extract(r"\?([^#]*)", expand=False).fillna("")
    length = url.str.len()
    return np.column_stack([
        length, host.str.len(), path.str.len(), path.str.count("/"), host.str.count(r"\.") + 1, url.str.count(r"[0-9]") / length.clip(lower=1),
        [entropy(u) for u in url], query.str.count("=") + query.str.count("&"), url.str.count("-"), url.str.contains("#").astype(float), shares[one.to_numpy()], shares[two.to_numpy()],
    ]).astype(np.float32)


@dataclass
class Boosted:
    """Gradient-boosted regression trees of a fixed depth for logistic loss; splits on quantile bins."""

    bias: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and threshold by inner node, value by leaf
    rate: float = 0.2

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), int)
            while node.size and node[0] < len(feature):  # a complete tree: all rows are at the same depth
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += self.rate * leaf[node - len(feature)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, bins: int = 32, l2: float = 1.0) -> Boosted:
    """Fit. Without rows or with one class only, the prior alone is returned."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Boosted(float(np.log(prior / (1 - prior))), [])
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    margin, inner = np.full(len(y), model.bias), 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for level in range(depth):
            first = 2**level - 1
            best = np.full(2**level, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (node - first) * (len(e) + 1) + binned[:, j]
                g = np.bincount(cell, grad, 2**level * (len(e) + 1)).reshape(2**level, -1).cumsum(1)
                h = np.bincount(cell, hess, 2**level * (len(e) + 1)).reshape(2**level, -1).cumsum(1)
                gain = (g**2 / (h + l2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2))[:, :-1]
                at = gain.argmax(1)
                top = gain[np.arange(2**level), at]
                for k in np.flatnonzero(top > best):
                    best[k], feature[first + k], threshold[first + k] = top[k], j, e[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        leaf = g / (h + l2)
        model.trees.append((feature, threshold, leaf))
        margin += model.rate * leaf[node - inner]
    return model


def _fitted(known: DataFrame, shares: np.ndarray, labelled: int) -> Boosted:
    """Trees of the SAMPLE labelled rows that come first by hash. Tasks compute features of somewhat more rows than
    that, and the driver gets the features of the sample, never a URL."""
    share = min(1.0, 1.2 * SAMPLE / max(labelled, 1))
    picked = known.select("*", F.xxhash64("url", "key").alias("order")).where(F.shiftrightunsigned("order", 12) < int(share * 2**52) + 1)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = lexical(b.url, b.host, b.path, b.one, b.two, shares)
            yield pd.DataFrame({"order": b.order, "y": (b.said == "allow").astype(float), "x": list(x)})

    rows = picked.mapInPandas(features, "order long, y double, x array<float>")
    rows = rows.orderBy(F.shiftrightunsigned("order", 12), "order", "x").limit(SAMPLE).toPandas()
    return boosted(np.array(rows.x.to_list(), np.float32), rows.y.to_numpy()) if len(rows) else Boosted(0.0, [])


def filtered(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id") -> DataFrame:
    """Rows (key, host, path, rule, verdict, allow_score), one per row of pages.

    allow_score is the trees' probability of allow, for every row; the verdict is the rule's where one fits, else
    allow from 0.5 on. A null URL or one without :// has empty host and path and is judged by the trees; keys may
    be null or repeated; without labelled URLs the score is 0.5 everywhere; an empty table gives no rows.
    """
    spark = pages.sparkSession
    p = plain(pages, key, url).toDF("key", "url")
    host, path = parts(F.col("url"))
    p = p.select("key", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    bucket = lambda n: F.pmod(F.xxhash64(F.substring_index("host", ".", -n), F.lit(n)), F.lit(BUCKETS)).cast("int")
    p = p.select("*", rule.alias("rule"), verdict.alias("said"), bucket(1).alias("one"), bucket(2).alias("two"))
    known = p.where("said is not null")
    stats = known.select(F.explode(F.array("one", "two")).alias("bucket"), (F.col("said") == "allow").cast("int").alias("y"))
    shares, labelled = np.full(BUCKETS, 0.5, np.float32), 0
    for b, n, good in stats.groupBy("bucket").agg(F.count("*"), F.sum("y")).collect():  # BUCKETS rows at most
        shares[b], labelled = (good + 1) / (n + 2), labelled + n // 2
    model = _fitted(known, shares, labelled)
    sent = spark.sparkContext.broadcast((model.bias, model.trees, shares))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bias, trees, shares = sent.value
        model = Boosted(bias, trees)
        for b in batches:
            score = 1 / (1 + np.exp(-model.margin(lexical(b.url, b.host, b.path, b.one, b.two, shares))))
            yield pd.DataFrame({"key": b["key"], "host": b.host, "path": b.path, "rule": b.rule, "verdict": b.said.where(b.said.notna(), np.where(score >= 0.5, "allow", "block")), "allow_score": score})

    kind = p.schema["key"].dataType.simpleString()
    return p.mapInPandas(run, f"key {kind}, host string, path string, rule string, verdict string, allow_score double").withColumnRenamed("key", key)
