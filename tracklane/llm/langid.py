"""Language identification by mixture inference over character n-grams.

Learning: trigram counts (in hash buckets, so that a language's table is bounded) of every training text, summed by
language over all partitions; only buckets that a language has are stored. Inference: expectation-maximisation estimates a document's language
proportions from the likelihoods of its trigrams; the language set is the one with the best penalised likelihood
among those that grow by one language at a time. A flat noise model takes part in every set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain

BUCKETS, SMOOTH, ROUNDS = 1 << 15, 0.5, 25
#: Languages whose counts a task holds before it passes them on, and probabilities that inference holds at once.
HELD, AT_ONCE = 256, 1 << 22
#: The noise model's probability of any trigram.
NOISE = 2.0**-17


def _letters() -> np.ndarray:
    """Whether each code point is a letter; kept by the process beside numpy."""
    kept = np.__dict__.setdefault("_letter_table", [])
    if not kept:
        kept.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return kept[0]


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams around each letter, all else read as one blank; none for a text without letters."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[c]
    c = np.where(letter, c, 32)
    mid = letter[1:-1]
    h = (c[:-2] * 0x9E3779B1 + c[1:-1] * 0x85EBCA77 + c[2:] * 0xC2B2AE3D)[mid]
    return ((h ^ (h >> 15)) * 0x27D4EB2F >> 7) & (BUCKETS - 1)


@dataclass
class Model:
    """Probabilities of buckets by language, by bucket: the languages that have it and their probability of it. A
    language that lacks a bucket gives it its own least probability."""

    langs: list[str]
    least: np.ndarray  # by language
    starts: np.ndarray  # where a bucket's entries start, BUCKETS + 1
    lang: np.ndarray  # an entry's language
    p: np.ndarray  # an entry's probability

    @classmethod
    def of(cls, langs: list[str], bucket: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Model:
        """From counts of buckets by language (an index of langs), each pair once."""
        total = np.bincount(lang, n, len(langs)) + SMOOTH * BUCKETS
        order = np.argsort(bucket, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))))
        return cls(langs, (SMOOTH / total).astype(np.float32), starts, lang[order].astype(np.int32), ((n + SMOOTH) / total[lang])[order].astype(np.float32))

    def rows(self, b: np.ndarray) -> np.ndarray:
        """(buckets, languages and noise)"""
        out = np.empty((len(b), len(self.langs) + 1))
        out[:, :-1], out[:, -1] = self.least, NOISE
        first, many = self.starts[b], self.starts[b + 1] - self.starts[b]
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        out[np.repeat(np.arange(len(b)), many), self.lang[at]] = self.p[at]
        return out

    def mixture(self, text: str | None) -> tuple[str, float, dict[str, float], float]:
        """The leading language and its share, all shares over a hundredth, and the share of noise.

        `und` with score 0 for texts without letters, and where no language was learned.
        """
        grams = trigrams(text)
        if not len(grams) or not self.langs:
            return "und", 0.0, {}, 1.0
        if len(grams) > 4096:
            n = np.bincount(grams, minlength=BUCKETS)
            b = np.flatnonzero(n)
            n = n[b]
        else:
            b, n = np.unique(grams, return_counts=True)
        n, step = n.astype(np.float64), max(1, AT_ONCE // (len(self.langs) + 1))
        parts = range(0, len(b), step)
        once = [(self.rows(b), n)] if len(parts) == 1 else None

        def blocks(columns=slice(None)) -> Iterable[tuple[np.ndarray, np.ndarray]]:
            """Probabilities and counts; made anew for each round where they are too many to be held."""
            return ((p[:, columns], c) for p, c in once or ((self.rows(b[i : i + step]), n[i : i + step]) for i in parts))

        total, noise = n.sum(), len(self.langs)
        share, _ = _em(blocks, total, noise + 1)
        order = np.argsort(-share[:-1], kind="stable")
        best = None
        for k in range(1, len(order) + 1):  # grow the set by the language with the next largest share
            if k > 1 and share[order[k - 1]] < 1e-3:
                break
            chosen = [*order[:k].tolist(), noise]
            held = [(np.ascontiguousarray(p), c) for p, c in blocks(chosen)]
            sub, fit = _em(lambda held=held: held, total, len(chosen))
            score = fit - 0.5 * k * np.log(total + 1)
            if best is not None and score <= best[0]:
                break
            best = (score, dict(zip(chosen, sub.tolist(), strict=True)))
        shares = best[1]
        flat = shares.pop(noise)
        top = max(shares, key=lambda i: (shares[i], -i))
        return self.langs[top], min(1.0, shares[top]), {self.langs[i]: s for i, s in shares.items() if s >= 0.01}, flat


def _em(blocks: Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]], total: float, size: int) -> tuple[np.ndarray, float]:
    """Shares that maximise the likelihood of the mixture of columns, and its logarithm; blocks() gives (p, n) parts."""
    share = np.full(size, 1 / size)
    for _ in range(ROUNDS):
        new = share * sum((n / (p @ share)) @ p for p, n in blocks()) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share, float(sum(n @ np.log(p @ share) for p, n in blocks()))


def learned(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows with a language. It holds the buckets that occur in each language, 8 bytes each: at most
    256 kB a language, and as many as there are languages, not as there are documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pd.DataFrame]:
            for g, s in sums.items():
                at = np.flatnonzero(s)
                yield pd.DataFrame({"lang": g, "bucket": at.astype(np.int32), "n": s[at]})
            sums.clear()

        for b in batches:
            for t, g in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                if g not in sums and len(sums) >= HELD:
                    yield from told()
                own = sums.setdefault(g, np.zeros(BUCKETS, np.int64))
                if t and len(t) > 4096:
                    own += np.bincount(trigrams(t), minlength=BUCKETS)
                elif t:
                    np.add.at(own, trigrams(t), 1)
        yield from told()

    d = plain(train, text, lang).where(F.col(lang).isNotNull())
    counts = d.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(counts.lang.unique().tolist())
    code = counts.lang.map({g: i for i, g in enumerate(langs)}).to_numpy(np.int64)
    return Model.of(langs, counts.bucket.to_numpy(np.int64), code, counts.n.to_numpy(np.float64))


SCHEMA = "lang string, score double, noise double, mixture map<string,double>"


def predictor(df: DataFrame, model: Model):
    """A pandas UDF of a text column: struct<lang, score, noise, mixture>. Equal texts of a batch are inferred once."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def infer(texts: pd.Series) -> pd.DataFrame:
        m, seen, rows = sent.value, {}, []
        for t in texts:
            if t not in seen:
                lang, score, mixture, noise = m.mixture(t)
                seen[t] = (lang, score, noise, mixture)
            rows.append(seen[t])
        return pd.DataFrame(rows, columns=["lang", "score", "noise", "mixture"])

    from pyspark.sql.functions import pandas_udf

    infer.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return pandas_udf(infer, SCHEMA)


def identified(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Rows (key, lang_pred, score, mixture, noise), one per row of docs, learned from rows where train holds.

    `und` with score 0 for null texts and those without letters, and if no row has a language. Keys may be null or
    repeated; an empty table gives none.
    """
    d = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("lang"), F.coalesce(train, F.lit(False)).alias("train"))
    model = learned(d.where("train"), "text", "lang")
    out = d.select("key", predictor(docs, model)("text").alias("r"))
    return out.select(F.col("key").alias(key), F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), "r.mixture", "r.noise")
