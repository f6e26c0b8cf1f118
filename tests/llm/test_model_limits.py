"""Long labelled documents, very large corpora, and scores of the fitted models in plain loops."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklane.llm import hmm, quality

LONG = " ".join(f"word{i % 97} and-more, {i}." for i in range(9000))


def plain_score(text, p):
    """Gated attention in loops over passages."""
    h = (quality.encoded(text) - p["mean"]) * p["scale"]
    e = []
    for x in h:
        t = np.tanh(x @ p["V"] + p["vb"])
        g = 1 / (1 + np.exp(-(x @ p["U"] + p["ub"])))
        e.append(math.exp(float((t * g) @ p["w"])))
    z = sum(a / sum(e) * x for a, x in zip(e, h, strict=True))
    return 1 / (1 + math.exp(-float(np.tanh(z @ p["M"] + p["mb"]) @ p["c"] + p["b"])))


@pytest.mark.parametrize("short", [0, 6])
def test_long_labelled_documents_are_fitted_on(spark, short):
    """Tables, and so partitions, of nothing but long labelled documents, and one of a single document."""
    assert len(quality.encoded(LONG)) > quality.SAMPLE_PASSAGES
    rows = [(i, LONG if i >= short else "a few words !!!") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i >= 6)) for i in range(12)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(docs, labels, F.lit(True)).collect()}
    p = quality.learned(docs, labels, F.lit(True))
    for i, text in rows:
        assert got[i].score == pytest.approx(plain_score(text, p), abs=1e-5) and got[i].passages == len(quality.encoded(text))
    if short:
        assert got[0].score < 0.3 and got[11].score > 0.7
    assert quality.judged(docs.where("doc_id = 7"), labels.where("doc_id = 7"), F.lit(True)).count() == 1


@pytest.mark.parametrize("words", [1e9, 1e12, 1e15])
def test_rounds_stay_finite_in_any_corpus(words):
    """Six populations of words that hardly mix, and one text that goes from one to the next at each word."""
    parts = [np.arange(1 + i * 600, 601 + i * 600) for i in range(6)]
    share = np.full(hmm.CLASSES, 0.5)
    share[1:3601] += words / 3600
    share /= share.sum()
    r = np.random.default_rng(0)
    texts = [np.append(r.choice(p, 500), 0) for p in parts]
    mixed = np.append([parts[i % 6][i % 600] for i in range(900)], 0)
    model = hmm.initial(share)
    for _ in range(hmm.ROUNDS):
        rest = hmm.stationary(model[1])
        sums = [np.zeros(6), np.zeros((6, 6)), np.zeros((6, hmm.CLASSES))]
        for text, times in [*((t, words / 3000) for t in texts), (mixed, 1)]:
            begin, moves, emitted, fit = hmm.expected([text], *model, share, rest)
            assert math.isfinite(fit) and moves.sum() == pytest.approx(len(text), rel=1e-4)
            sums = [a + b * times for a, b in zip(sums, (begin, moves, emitted), strict=True)]
        model = hmm.maximized(*sums, share)
    assert np.isfinite(hmm.likelihoods([mixed], *model)).all()
    with pytest.raises(ArithmeticError):
        hmm.maximized(np.full(6, np.nan), *sums[1:], share)


def test_scores_of_a_small_corpus_in_loops(spark, monkeypatch):
    """Counts, classes and the scaled forward recursion, word by word."""
    models = []
    real = hmm.baum_welch_round
    monkeypatch.setattr(hmm, "baum_welch_round", lambda *a: models.append(real(*a)) or models[-1])
    rows = [(i, None if i == 5 else " ".join(f"{'ab'[i % 2]}{(i * j) % 7} Word{j % 5}" for j in range(i))) for i in range(40)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r.doc_id: r for r in hmm.scored(docs, train).collect()}
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in rows if fold(i) != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    of = lambda w: int(hmm.sequence(w.decode())[0])
    within = Counter()
    for w, x in c.items():
        within[of(w)] += x + 0.5
    start, trans, emit = models[-1][0]
    for i, t in rows:
        state, log, base = start, 0.0, 0.0
        for w in words(t):
            state = (state @ trans) * emit[:, of(w)]
            log += math.log10(state.sum()) + math.log10((c[w] + 0.5) / (within[of(w)] + 0.5))
            state = state / state.sum()
            base += math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
        assert got[i].score == pytest.approx(log, rel=1e-5) and got[i].base_score == pytest.approx(base, rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words(t)), sum(c[w] > 0 for w in words(t)), n)
