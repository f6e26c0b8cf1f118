import numpy as np
from pyspark.sql import functions as F

from tracklane.llm import hmm


def test_every_round_reads_all_training_texts(spark, monkeypatch):
    read = []

    def round_(seqs, model, share):
        read.append(seqs.count())
        return model, 0.0

    monkeypatch.setattr(hmm, "baum_welch_round", round_)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), "id").alias("text"))
    hmm.scored(docs, F.col("doc_id") < 5000)
    assert read == [5000] * 11


def test_expected_counts_by_brute_force():
    """Forward and backward in plain loops, segment by segment."""
    rng = np.random.default_rng(3)
    share = rng.random(hmm.CLASSES) + 0.1
    share /= share.sum()
    start, trans, emit = hmm.initial(share)
    start = rng.random(hmm.STATES)
    start /= start.sum()
    resume = hmm.stationary(trans)
    seqs = [rng.integers(0, hmm.CLASSES, n) for n in (1, 7, 128, 129, 300)]
    begin, moves, emitted, fit = np.zeros(hmm.STATES), np.zeros_like(trans), np.zeros_like(emit), 0.0
    for s in seqs:
        for at in range(0, len(s), hmm.SEGMENT):
            x = s[at : at + hmm.SEGMENT]
            alpha = [start if at == 0 else resume]
            for c in x:
                alpha.append((alpha[-1] @ trans) * emit[:, c])
                fit += np.log(alpha[-1].sum())
                alpha[-1] /= alpha[-1].sum()
            beta = np.ones(hmm.STATES)
            for t in range(len(x) - 1, -1, -1):
                g = alpha[t + 1] * beta
                emitted[:, x[t]] += g / g.sum()
                m = alpha[t][:, None] * trans * (emit[:, x[t]] * beta)[None]
                moves += m / m.sum()
                beta = trans @ (emit[:, x[t]] * beta)
                beta /= beta.sum()
            if at == 0:
                begin += start * beta / (start * beta).sum()
    got = hmm.expected(seqs, start, trans, emit, share, resume)
    assert np.allclose(got[0], begin, atol=1e-3) and np.allclose(got[1], moves, atol=1e-2) and np.allclose(got[2], emitted, atol=1e-3)
    assert abs(got[3] - fit) < 1e-3 * abs(fit)


def test_rounds_raise_the_likelihood(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seqs = hmm.sequences(d).cache()
    share = np.bincount(np.concatenate([np.frombuffer(r.s, "<u2") for r in seqs.collect()]), minlength=hmm.CLASSES) + 0.5
    share /= share.sum()
    model, fits = hmm.initial(share), []
    for _ in range(4):
        model, fit = hmm.baum_welch_round(seqs, model, share)
        fits.append(fit)
    assert fits[0] < fits[1] < fits[2] < fits[3]


def test_short_sequences_by_vectors_equal_products():
    """Every sequence was scored by products of matrices, and classes were worked out for every word again."""
    rng = np.random.default_rng(5)
    share = rng.random(hmm.CLASSES) + 0.1
    start, trans, emit = hmm.initial(share / share.sum())
    seqs = [rng.integers(0, hmm.CLASSES, n) for n in (1, 5, 64, 65, hmm.DIRECT, hmm.DIRECT + 1, 3000)]
    x, _, active, place, first, per = hmm._laid_out(seqs)
    want = hmm._chained(*hmm._products(x, active, trans, emit), place, first, per, start)[0]
    assert np.allclose(hmm.likelihoods(seqs, start, trans, emit), want, rtol=1e-12)
    assert np.allclose(hmm._direct(seqs, start, trans, emit), want, rtol=1e-12)
    text = "A longer-than-seven word, caf\u00e9 \tit is A"
    words = [*text.encode().lower().split(), hmm.END]
    assert hmm._classes_of(words).tolist() == hmm.sequence(text).tolist()
