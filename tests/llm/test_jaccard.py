"""The pipeline's near-duplicate stage against exact Jaccard similarities of all pairs."""

import numpy as np

from tracklane.llm import common, jaccard, simhash


def kept(texts):
    """The first text of each component of the pairs of similarity 4/5 or more."""
    sets = [set(simhash.shingle_hashes(common.words_of(t), 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                least, other = sorted((group[i], group[j]))
                group = [least if g == other else g for g in group]
    return sorted(set(group))


def got(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.deduplicated(d).collect())


def words(r, n):
    return [f"w{x}" for x in r.integers(0, 10**6, n)]


def test_copies_among_texts_around_a_passage(spark):
    """Copies that share little beside a passage of many unlike texts."""
    r = np.random.default_rng(3)
    passage, texts = words(r, 30), []
    for i in range(150):
        own = words(r, 6)
        texts.append(" ".join(passage + own))
        if i % 3 == 0:
            texts.append(" ".join(passage + own[:3] + words(r, 3)))
    want = kept(texts)
    assert len(want) == 150
    assert got(spark, texts) == want


def test_short_copies_are_found(spark):
    """One word appended or changed at the end, in texts of 1 to 30 words."""
    r = np.random.default_rng(4)
    texts = []
    for n in range(1, 31):
        for _ in range(4):
            own = words(r, n)
            texts += [" ".join(own), " ".join(own + ["more"]), " ".join(own[:-1] + ["other"])]
    want = kept(texts)
    assert 120 < len(want) < 360
    assert got(spark, texts) == want


def test_links_are_decided_exactly(spark):
    """Pairs a little below a similarity of 4/5 stay, those at it or a little above don't."""
    r = np.random.default_rng(5)
    texts = []
    for n in (200, 400):
        for share in (0.78, 0.79, 0.799, 0.8, 0.801, 0.81):
            for _ in range(4):
                # of n shingles each, the first c are common: similarity c / (2 n - c)
                c = round(2 * n * share / (1 + share))
                own = words(r, n + 4)
                texts += [" ".join(own), " ".join(own[: c + 4] + words(r, n - c))]
    want = kept(texts)
    assert 48 < len(want) < 96
    assert got(spark, texts) == want


def test_pairs_grow_with_copies_of_an_absent_original(spark, monkeypatch):
    """Copies of 200 absent words, three edits each, of which a few in a hundred pairs are similar enough: the groups
    are those of all pairs, and of three times as many texts about as many times as many pairs are compared."""
    from tracklane.llm import jaccard

    pairs = []
    real = jaccard.rounds

    def counted(x, met, verified, old):
        return real(x, met, lambda p: verified(pairs.append(p.distinct().count()) or p), old)

    monkeypatch.setattr(jaccard, "rounds", counted)
    counts = {}
    for n in (300, 900):
        r = np.random.default_rng(9)
        original, texts = words(r, 200), []
        for _ in range(n):
            own = list(original)
            for i in r.choice(200, 3, replace=False).tolist():
                own[i] = f"x{r.integers(10**9)}"
            texts.append(" ".join(own))
        pairs.clear()
        assert got(spark, texts) == (kept(texts) if n < 400 else [0])
        counts[n] = sum(pairs)
    assert counts[900] < 4.5 * counts[300] and counts[900] < 0.3 * 900 * 899 / 2, counts


def test_strays_that_never_join_are_all_compared(spark):
    """Texts that share most of what they have but less than the similarity, and a few copies among them."""
    r = np.random.default_rng(10)
    base, texts = words(r, 150), []
    for i in range(60):
        own = list(base)
        for k in r.choice(150, 8, replace=False).tolist():
            own[k] = f"y{r.integers(10**9)}"
        texts.append(" ".join(own))
        if i % 6 == 0:
            texts.append(" ".join([*own[:-1], "end"]))
    want = kept(texts)
    assert 50 < len(want) <= 60
    assert got(spark, texts) == want


def test_pairs_within_two_bits_are_the_index_s_alone(spark, monkeypatch):
    """Without its links they stay apart: the prefix filter found them all once more, so that links changed nothing."""
    r = np.random.default_rng(8)
    print_of = lambda t: simhash.majority(jaccard.shingle_set(t, 5))
    own = words(r, 400)
    near = next(t for i in range(1000) if 1 <= (print_of(" ".join(own)) ^ print_of(t := " ".join([*own[:-1], f"other{i}"]))).bit_count() <= 2)
    far = words(r, 60)
    texts = [" ".join(own), near, " ".join(far), " ".join([*far[:-2], "some", "more"])]
    assert (print_of(texts[2]) ^ print_of(texts[3])).bit_count() > 2
    assert got(spark, texts) == [0, 2]
    linked = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda fps: linked(fps).where("false"))
    assert got(spark, texts) == [0, 1, 2]


def test_no_probes_of_the_index_go_through_the_driver(spark):
    """They were broadcast, 34 rows for each fingerprint, since Spark estimates them as large as the fingerprints."""
    r = np.random.default_rng(12)
    fps = spark.createDataFrame([(int(x),) for x in r.integers(-(2**63), 2**63, 500)], "fp long")
    plan = simhash.candidates(fps)._jdf.queryExecution().executedPlan().initialPlan()
    sent, rest = [], [plan]
    while rest:
        node = rest.pop()
        if node.nodeName().startswith("BroadcastExchange"):
            sent.append(node.toString())
        rest += [node.children().apply(i) for i in range(node.children().size())]
    assert not [x for x in sent if "Generate" in x]


def test_groups_are_the_same_where_nothing_is_broadcast(spark, monkeypatch):
    r = np.random.default_rng(13)
    monkeypatch.setattr(jaccard, "SENT", -1)
    texts = []
    for _ in range(40):
        own = words(r, 120)
        texts += [" ".join(own), " ".join([*own[:-2], "some", "more"]), " ".join(own)]
    assert got(spark, texts) == kept(texts) == list(range(0, 120, 3))


def test_a_sketch_holds_a_byte_for_each_cell(monkeypatch):
    """134 MB a task before. Counts beyond a byte are kept, and take wider cells only where they are many."""
    r = np.random.default_rng(14)
    for most in (10**6, 3):
        monkeypatch.setattr(jaccard, "CELLS", 1 << 10)
        monkeypatch.setattr(jaccard, "CHUNK", 1 << 8)
        table, want = jaccard.Counts(), np.zeros(1 << 10, np.int64)
        assert table.few.nbytes == jaccard.CELLS
        for i in range(1000):
            cells = np.concatenate((r.integers(0, 1 << 10, 50), [5, 5, 700])) if most > 3 or i % 2 else np.arange(600)
            table.add(cells)
            np.add.at(want, cells, 1)
        assert (table.few.itemsize > 1) == (most == 3)
        assert np.concatenate([table.chunk(i) for i in range(4)]).tolist() == want.tolist() and want.max() > 1000


def test_the_index_grows_with_the_texts(spark, monkeypatch):
    """It took only sets that share a shingle of their prefixes (none of these texts), whose number can grow much
    faster than that of the texts."""
    r, taken = np.random.default_rng(15), []
    linked = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda fps: linked(taken.append(fps.select("fp").distinct().count()) or fps))
    common_words = words(r, 12)
    for n, shared in ((40, False), (200, True)):
        texts = [" ".join([*words(r, 6), *(common_words[i % 4 :][:8] if shared else words(r, 8)), *words(r, 6)]) for i in range(n)]
        assert got(spark, texts) == kept(texts)
    assert taken == [40, 200]


def test_sets_of_few_texts_are_held_at_once(spark, monkeypatch):
    """A batch of Spark's, 10,000 texts, was turned into sets and handed on as a whole. Groups are the same."""
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"text": [str(i) for i in range(3000)]})
    parts = list(jaccard.slices(iter([b, b.slice(0, 0)])))
    assert max(x.num_rows for x in parts) == jaccard.TEXTS < 3000 and [t for x in parts for t in x["text"].to_pylist()] == b["text"].to_pylist()
    assert jaccard.lists([np.array([3, 1]), np.zeros(0, np.int64), np.array([2])]).to_pylist() == [[3, 1], [], [2]]
    monkeypatch.setattr(jaccard, "TEXTS", 7)
    r = np.random.default_rng(16)
    texts = []
    for _ in range(20):
        own = words(r, 60)
        texts += [" ".join(own), None, " ".join([*own[:-2], "some", "more"]), ""]
    assert got(spark, texts) == kept(texts) and len(kept(texts)) == 21
