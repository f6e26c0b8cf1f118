"""Connected components: slices of edges contracted in tasks, stars for what several slices leave."""

import numpy as np
import pytest

from tracklane import shared


def plain(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    return {x: top(x) for x in root}


def graph(r):
    """A long chain, a star, a clique of a few and links at random, in any direction and repeated."""
    edges = [(i, i + 1) for i in range(-300, 0)] + [(10_000, x) for x in range(1, 60)] + [(a, b) for a in range(20_000, 20_008) for b in range(20_000, a)]
    edges += r.integers(30_000, 31_000, (400, 2)).tolist()
    edges = [tuple(e) for e in edges + edges[:50] if e[0] != e[1]]
    return [edges[i] for i in r.permutation(len(edges))]


@pytest.mark.parametrize(("slice_of", "as_text"), [(1 << 20, False), (1 << 20, True), (40, False)])
def test_components_are_those_of_a_plain_search(spark, monkeypatch, slice_of, as_text):
    monkeypatch.setattr(shared, "SLICE", slice_of)
    edges = graph(np.random.default_rng(2))
    edges = [(f"né{a}", f"né{b}") for a, b in edges] if as_text else edges
    d = spark.createDataFrame([*edges, (None, edges[0][0])], f"a {'string' if as_text else 'long'}, b {'string' if as_text else 'long'}").repartition(5)
    assert sorted(tuple(r) for r in shared.components(d).select("node", "root").collect()) == sorted(plain(edges).items())


def test_slices_hold_no_more_edges_than_named(monkeypatch):
    """A task contracts its edges in slices, whatever it reads."""
    import pandas as pd

    monkeypatch.setattr(shared, "SLICE", 10)
    sizes, real = [], shared.contracted
    monkeypatch.setattr(shared, "contracted", lambda v, u: sizes.append(len(v)) or real(v, u))
    batches = [pd.DataFrame({"v": np.arange(i, i + 4) + 1, "u": np.arange(i, i + 4)}) for i in range(0, 40, 4)]
    out = pd.concat(shared._slices(iter(batches)))
    assert sizes == [12, 12, 12, 4] and len(out) == 40


def test_few_edges_take_few_tables(spark, monkeypatch):
    """The driver plans no rounds for edges that one slice has; there were a table and two jobs for each round."""
    tables, real = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, keep=None: tables.append(1) or real(df, keep))
    d = spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long")
    assert {r.root for r in shared.components(d).collect()} == {0}
    assert len(tables) == 2
    assert shared.components(d.where("false")).isEmpty()
