"""Hidden Markov language model of words.

Latent states emit classes of words: a class is a hash of a word's first and last two bytes and its length (up to 7),
so that short words have a class of their own and unseen long words share one with words of like form. A word is
drawn within its class by its corpus count plus a half. States are trained by Baum-Welch: expected counts of each
partition are summed over partitions; every round runs over all training texts, cut into segments of SEGMENT words
(those after a text's first start from the states' shares). A text's probability is exact: the forward recursion, scaled, over the whole text and its end.

Word counts of the whole corpus are looked up without a table that each task holds: texts are dealt to blocks, each
block asks for its distinct words, counts are summed by word (combined before the shuffle) and joined back to the
blocks that asked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, dropped, shuffle_partitions, word_spans, written

#: STATES x CLASSES numbers are all that a task holds of the model.
STATES, CLASSES, ROUNDS, PRIOR, CHUNK, SEGMENT, RESCALE, BLOCK_BYTES, BATCH = 6, 4096, 11, 20.0, 64, 128, 4, 8_000_000, 400_000
#: Of a state's emissions and moves, the shares that priors have at least. With them no word is less than a ten
#: thousandth as likely in a state as in the corpus however large that is, which keeps vectors within single precision
#: for RESCALE steps.
LEAST_EMITTED, LEAST_MOVED = 1e-4, 1e-6
END = b""
#: Sequences up to this length are scored by vectors, longer ones by products of matrices.
DIRECT = 1024


def classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each word, from 1 on; class 0 is the end of a text."""
    n = np.minimum(ends - starts, 7)
    a, b, c, d = (data[np.minimum(np.maximum(i, starts), ends - 1)].astype(np.int64) for i in (starts, starts + 1, ends - 2, ends - 1))
    h = (((n * 257 + a) * 257 + b) * 257 + c) * 257 + d
    h = (h * 0x9E3779B1) & 0xFFFFFFFFFF
    return ((h ^ (h >> 17)) * 0x85EBCA77 >> 13) % (CLASSES - 1) + 1


def _classes_of(words: list[bytes]) -> np.ndarray:
    """The class of each of some lower-cased words, END among them."""
    data = np.frombuffer(b" ".join(words) or b" ", np.uint8)
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    of = np.zeros(len(words), np.int64)
    real = np.flatnonzero(size)
    of[real] = classes(data, (ends - size)[real], ends[real])
    return of


def sequence(text: str | None) -> np.ndarray:
    """Classes of a text's words and its end."""
    data = LOWER_BYTES[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(data):
        return np.zeros(1, np.int64)
    return np.append(classes(data, *word_spans(data)), 0)


def _laid_out(seqs: list[np.ndarray], chunk: int = CHUNK) -> tuple:
    """Chunks of all sequences, longest first: their symbols by step, lengths, and where each sequence's chunks are."""
    size = np.array([len(s) for s in seqs])
    per = -(-size // chunk)
    first = np.concatenate(([0], np.cumsum(per)[:-1]))
    flat = np.full(int(per.sum()) * chunk, -1, np.int64)
    # a sequence's symbols follow each other from its first chunk on
    flat[np.arange(int(size.sum())) + np.repeat(first * chunk - np.concatenate(([0], np.cumsum(size)[:-1])), size)] = np.concatenate(seqs)
    length = np.full(len(flat) // chunk, chunk)
    length[first + per - 1] = size - (per - 1) * chunk
    order = np.argsort(-length, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    length = length[order]
    active = np.searchsorted(-length, -np.arange(chunk), side="left")  # chunks longer than t
    return flat.reshape(-1, chunk)[order], length, active, place, first, per


def _products(x: np.ndarray, active: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's scaled product of trans @ diag(emission), and the logarithm of its scale."""
    k = len(trans)
    m = np.broadcast_to(np.eye(k), (len(x), k, k)).copy()
    log = np.zeros(len(x))
    by_class = np.ascontiguousarray(emit.T)
    for t in range(CHUNK):
        n = active[t]
        if not n:
            break
        step = (m[:n].reshape(-1, k) @ trans).reshape(n, k, k)
        step *= by_class[x[:n, t]][:, None, :]
        scale = step.sum((1, 2))
        m[:n] = step / scale[:, None, None]
        log[:n] += np.log(scale)
    return m, log


def _chained(m: np.ndarray, log: np.ndarray, place: np.ndarray, first: np.ndarray, per: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each sequence and the scaled state vector before each chunk."""
    order = np.argsort(-per, kind="stable")
    v = np.tile(start, (len(per), 1))
    total = np.zeros(len(per))
    before = np.zeros((len(m), len(start)))
    for c in range(int(per.max(initial=0))):
        live = order[: int((per > c).sum())]
        at = place[first[live] + c]
        before[at] = v[live]
        w = np.einsum("ni,nij->nj", v[live], m[at])
        scale = w.sum(1)
        total[live] += np.log(scale) + log[at]
        v[live] = w / scale[:, None]
    return total, before


def likelihoods(seqs: list[np.ndarray], start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural logarithm of each sequence's probability."""
    out = np.zeros(len(seqs))
    size = np.array([len(s) for s in seqs], int)
    short = np.flatnonzero(size <= DIRECT)
    if len(short):
        out[short] = _direct([seqs[i] for i in short], start, trans, emit)
    long = np.flatnonzero(size > DIRECT)
    if len(long):
        x, _, active, place, first, per = _laid_out([seqs[i] for i in long])
        m, log = _products(x, active, trans, emit)
        out[long] = _chained(m, log, place, first, per, start)[0]
    return out


def _direct(seqs: list[np.ndarray], start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """likelihoods() by vectors that move through all sequences in step."""
    x, _, active, place, *_ = _laid_out(seqs, max(map(len, seqs)))
    x, moved = np.ascontiguousarray(x.T), np.ascontiguousarray(trans.T)
    v, log = np.tile(start[:, None], (1, x.shape[1])), np.zeros(x.shape[1])
    for t, n in enumerate(active.tolist()):
        step = (moved @ v[:, :n]) * emit.take(x[t, :n], axis=1)
        scale = step.sum(0)
        v[:, :n] = step / scale
        log[:n] += np.log(scale)
    return log[place]


def expected(seqs: list[np.ndarray], start: np.ndarray, trans: np.ndarray, emit: np.ndarray, share: np.ndarray, resume: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected counts of start states, transitions and emissions, and the log-likelihood, over segments.

    Forward and backward vectors of all segments move in step. Emissions are taken relative to the classes' shares, so
    that they are near one and vectors need scaling every RESCALE steps only.
    """
    k = len(start)
    x, length, active, place, first, _ = _laid_out(seqs, SEGMENT)
    x = np.ascontiguousarray(x.T)
    relative = (emit / share).astype(np.float32)
    trans32 = trans.astype(np.float32)
    n_all, steps = x.shape[1], int((active > 0).sum())
    head = np.zeros(n_all, bool)
    head[place[first]] = True
    # states are rows, so that steps run along segments
    alpha = np.zeros((steps + 1, k, n_all), np.float32)
    alpha[0] = np.where(head, start[:, None], resume[:, None])
    fit, e, scales = 0.0, [], {}
    for t in range(steps):
        n = active[t]
        e.append(relative.take(x[t, :n], axis=1))
        a = (trans32.T @ alpha[t, :, :n]) * e[t]
        if t % RESCALE == RESCALE - 1:
            scales[t] = scale = a.sum(0)
            fit += float(np.log(scale).sum())
            a /= scale
        alpha[t + 1, :, :n] = a
    ends = alpha[length, :, np.arange(n_all)].sum(1)
    fit += float(np.log(ends).sum()) + float(np.log(share)[np.concatenate(seqs)].sum())
    moves, weights, symbols = np.zeros((k, k)), [], []
    beta = np.ones((k, n_all), np.float32)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        b = beta[:, :n]
        eb = e[t] * b
        back = trans32 @ eb
        gamma = alpha[t + 1, :, :n] * b
        whole = gamma.sum(0)
        gamma /= whole
        weights.append(gamma)
        symbols.append(x[t, :n])
        # the sum of alpha[t] * back is the same, before the scaling of alpha[t + 1]
        norm = whole * scales[t] if t in scales else whole
        moves += (alpha[t, :, :n] / norm) @ eb.T
        if t % RESCALE == 0:
            back /= back.sum(0)
        beta[:, :n] = back
    begin = start[:, None] * beta[:, head]
    begin = (begin / begin.sum(0)).sum(1)
    symbol = np.concatenate(symbols)
    emitted = np.stack([np.bincount(symbol, w, CLASSES) for w in np.concatenate(weights, 1)])
    return begin, moves * trans, emitted, fit


def _batches(seqs: Iterator[np.ndarray], tokens: int = BATCH) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for s in seqs:
        held.append(s)
        n += len(s)
        if n >= tokens:
            yield held
            held, n = [], 0
    if held:
        yield held


def initial(share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A start: states that stay, and emissions around the classes' shares."""
    rng = np.random.Generator(np.random.PCG64(11))
    emit = share * (0.5 + rng.random((STATES, CLASSES)))
    trans = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(trans, 0.9)
    return np.full(STATES, 1 / STATES), trans, emit / emit.sum(1, keepdims=True)


def sequences(texts: DataFrame) -> DataFrame:
    """Rows (s): the classes of each text as 16-bit numbers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            yield pd.DataFrame({"s": [sequence(t).astype("<u2").tobytes() for t in b["text"]]})

    return texts.select("text").mapInPandas(run, "s binary")


def baum_welch_round(seqs: DataFrame, model: tuple, share: np.ndarray) -> tuple[tuple, float]:
    """One round over a table of sequences: counts by partition, summed, and the new parameters."""
    sent = seqs.sparkSession.sparkContext.broadcast((*model, share, stationary(model[1])))
    width = STATES + STATES * STATES + STATES * CLASSES + 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(width)
        for b in parts:
            for some in _batches(np.frombuffer(s, "<u2").astype(np.int64) for s in b["s"]):
                begin, moves, emitted, fit = expected(some, *sent.value)
                sums += np.concatenate((begin, moves.ravel(), emitted.ravel(), [fit]))
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"i": at.astype(np.int32), "x": sums[at]})

    got = seqs.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow().to_pandas()
    sums = np.zeros(width)
    sums[got.i.to_numpy()] = got.x.to_numpy()
    return maximized(sums[:STATES], sums[STATES : STATES + STATES**2].reshape(STATES, STATES), sums[STATES + STATES**2 : -1].reshape(STATES, CLASSES), share), float(sums[-1])


def maximized(begin: np.ndarray, moves: np.ndarray, emitted: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters from expected counts and priors."""
    begin = begin + 0.1
    moves = moves + np.maximum(0.1, LEAST_MOVED * moves.sum(1, keepdims=True))
    emitted = emitted + np.maximum(PRIOR, LEAST_EMITTED * emitted.sum(1, keepdims=True)) * share
    if not all(np.isfinite(x).all() for x in (begin, moves, emitted)):
        raise ArithmeticError("expected counts that are no numbers")
    return begin / begin.sum(), moves / moves.sum(1, keepdims=True), emitted / emitted.sum(1, keepdims=True)


def stationary(trans: np.ndarray) -> np.ndarray:
    """The states' shares in the long run."""
    return np.linalg.matrix_power(trans, 1 << 12)[0]


def scored(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_tokens, n_known, train_tokens, base_score, score), one per row of docs.

    Learned from rows where train holds. Null and empty texts are their end alone; keys may be null or repeated
    (each row is scored); without training rows every count is zero and states are left at their start; an empty
    table gives no rows.
    """
    spark, old = docs.sparkSession, []
    d = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    parts = max(shuffle_partitions(spark), blocks // 2)
    dealt = d.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int")).repartition(parts, "block")

    def ask(block: pd.DataFrame) -> pd.DataFrame:
        seen, learned = Counter(), Counter()
        for t, of in zip(block["text"], block["train"], strict=True):
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            words.append(END)
            (learned if of else seen).update(words)
        words = list(learned.keys() | seen.keys())
        of = _classes_of(words)
        return pd.DataFrame({"word": words, "block": block["block"].iloc[0], "class": of.astype(np.int32), "n": np.array([learned[w] for w in words], np.int64)})

    asked = dealt.groupBy("block").applyInPandas(ask, "word binary, block int, class int, n long")
    asked = written(asked)
    counts = written(asked.groupBy("word").agg(F.sum("n").alias("c"), F.min("class").alias("class")))
    told = asked.select("word", "block").join(counts.select("word", "c"), "word")
    mass = counts.where("c > 0").groupBy("class").agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()  # CLASSES rows at most
    n_train, v_train = sum(r["n"] for r in mass), sum(r["v"] for r in mass)
    within = np.full(CLASSES, 0.5)
    for r in mass:
        within[r["class"]] += r["n"] + 0.5 * r["v"]
    share = within / within.sum()
    model = initial(share)
    if n_train:
        learn = written(sequences(d.where("train")), old)
        for _ in range(ROUNDS):
            model, _fit = baum_welch_round(learn, model, share)
        dropped(spark, old)
    base = float(np.log10(n_train + 0.5 * (v_train + 1)))
    sent = spark.sparkContext.broadcast((model, np.log10(within)))

    def score(block: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        (start, trans, emit), log_within = sent.value
        c = words["c"].to_numpy()
        at = dict(zip(words["word"].tolist(), range(len(c)), strict=True))
        log = np.log10(c + 0.5)
        rows, seqs, of = [], [], _classes_of(words["word"].tolist())
        for t in block["text"]:
            tokens = (t or "").encode("utf-8", "surrogatepass").lower().split()
            tokens.append(END)
            i = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
            s = of[i]
            seqs.append(s)
            own = float(log[i].sum())
            rows.append((len(tokens), int((c[i] > 0).sum()), own - len(tokens) * base, own - float(log_within[s].sum())))
        fit = np.concatenate([likelihoods(b, start, trans, emit) for b in _batches(iter(seqs))]) / np.log(10)
        n, known, flat, inner = (np.array(x) for x in zip(*rows, strict=True))
        return pd.DataFrame({"key": block["key"].to_numpy(), "n_tokens": n, "n_known": known, "train_tokens": n_train, "base_score": flat, "score": inner + fit})

    answers = told.select("word", "block", "c").repartition(parts, "block")
    kind = d.schema["key"].dataType.simpleString()
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
