"""Operators of the llm subpackage against brute force, round trips and held-out accuracy, and on odd tables."""

import datetime
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklane.llm import common, cws, hmm, jaccard, langid, media, mixing, packing, pii, quality, queries, simhash, urlfilter

SF = "/root/testdata/sf0.001"
NASTY = "doc_id long, text string, lang string, source string, n_chars long, key long, block int, h int, wide int, size int, cut int, at double, fp long, range int, base string"
ROWS = [
    (1, "The cat sat on the mat and the dog ran after it all day long. mail a@b.co", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, "The cat sat on the mat and the dog ran after it all day long. mail a@b.co", "en", None),
    (4, "The cat sat on the mat and the dog ran after it all day long. mail a@b.co", "en", None), (None, "le chat est sur la table et le chien court", "fr", "s2"), (6, "12345 !!", None, "s2"), (7, "word " * 30000, "en", "s2"), (8, "x" * 20000, "de", "s3"), (9, "é😀 " * 50, "fr", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[0] * 6, 0.0, 0, 0, "z") for r in ROWS], NASTY)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


OPERATORS = {
    "packing": lambda d, s: packing.packed(d, queries.vocabulary()),
    "quality": lambda d, s: quality.judged(d, s.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int"), F.lit(True)),
    "media": lambda d, s: media.digests(d),
    "language": lambda d, s: langid.identified(d, F.lit(True)),
    "sampling": lambda d, s: cws.edit_study(d),
    "hmm": lambda d, s: hmm.scored(d, F.lit(True)),
    "simhash": lambda d, s: simhash.near_groups(d),
    "mixing": lambda d, s: mixing.shares(d),
    "pii": lambda d, s: pii.personal(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, docs, name):
    rows = OPERATORS[name](docs, spark).collect()
    ids = Counter(r.doc_id for r in rows)
    if name == "packing":
        assert set(ids) == {r[0] for r in ROWS}
    else:
        assert ids == Counter(r[0] for r in ROWS)
    assert OPERATORS[name](docs.where("false"), spark).count() == 0


def test_url_filter_odd_rows(spark):
    rows = [(1, "http://A.Example.org/es/x?q#f"), (2, None), (3, "no scheme"), (4, "ftp://com/fr/"), (4, "http://x.com/de/1"), (None, "http://notorg/"), (6, "http://org"), (7, "http://q.example.org/en/12"), (8, "http://" + "a" * 50000 + ".net/")]
    p = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, key int")
    got = {(r.page_id, r.host[:20], r.path): (r.rule, r.verdict) for r in urlfilter.filtered(p, queries.RULES).collect()}
    assert len(got) == len(rows)
    assert got[1, "a.example.org", "/es/x"] == ("example.org/es/", "block") and got[7, "q.example.org", "/en/12"] == ("example.org/en/1", "block")
    assert got[4, "com", "/fr/"] == ("com/fr/", "allow") and got[4, "x.com", "/de/1"] == ("com/de/", "block")
    assert got[2, "", ""][0] is None and got[3, "", ""][0] is None and got[6, "org", ""][0] is None and got[None, "notorg", "/"][0] is None
    assert urlfilter.filtered(p.where("false"), queries.RULES).count() == 0


def test_trees_learn_a_step():
    x = np.random.default_rng(0).random((2000, 3)).astype(np.float32)
    y = (x[:, 1] > 0.4).astype(float)
    assert ((urlfilter.boosted(x, y).margin(x) > 0) == (y > 0)).mean() > 0.99


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=packing.SAME_CLASSES - 1), max_size=60))
def test_both_tokenizers_agree(text):
    import tokenizers

    full = tokenizers.Tokenizer.from_file(queries.vocabulary())
    for t in (text, f"{text}<|endoftext|> {text}", "hello <|endoftext|> world"):
        assert packing.tokenizer(queries.vocabulary())(t) == full.encode(t, add_special_tokens=False).ids


def test_packing_is_gapless_and_tight(spark, table):
    p = packing.packed(table, queries.vocabulary()).toPandas()
    encode = packing.tokenizer(queries.vocabulary())
    texts = dict(table.select("doc_id", "text").collect())
    for k, own in p.groupby("doc_id"):
        ids = [*encode(texts[k]), 0]
        own = own.sort_values("piece")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n in zip(own.start, own.length)]
    for _, own in p.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert p.sequence_id.nunique() <= math.ceil(p.length.sum() / 2048) + 4


def test_best_fit_closes_the_fullest():

    places = list(packing.best_fit([6, 5, 8, 4], 10, 2))
    assert places == [(0, 0), (1, 0), (2, 0), (1, 5)]  # 8 opened a third bin, so the one with 6 closed


def test_held_out_quality(spark, table):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels, common.fold(labels.doc_id, 4) != 2)
    x = got.join(labels, "doc_id").where(common.fold(F.col("doc_id"), 4) == 2).toPandas()
    assert (x.predicted == x.quality).mean() > 0.95


def test_media_round_trip():
    for text in ("", None, "a" * 63, "ab" * 32, "é😀" * 700):
        payload, data = media.to_avi(text)
        avi = media.parse_avi(data)
        back = b"".join(media.payload_of(c) for c, _ in media.decode_frames(avi.frames))
        assert back == payload and len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == (text or "").encode().rstrip(b"\0")
    every = bytes(range(256)) * 3
    frames = media.encode_frames(every)
    assert b"".join(media.payload_of(c) for c, _ in media.decode_frames(frames)) == every
    with pytest.raises(ValueError):
        media.parse_avi(b"nothing")


def test_clips_cover_each_file(spark, docs):
    m = media.media_column(docs.where("doc_id = 7"))
    c = media.clips(m).orderBy("clip").toPandas()
    assert c.start_s[0] == 0 and (c.start_s[1:].to_numpy() == c.end_s[:-1].to_numpy()).all() and c.frames.sum() == len(media.parse_avi(m.first().media).frames)


def test_held_out_languages(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identified(t, common.fold(t.doc_id, 3) != 1).join(t, "doc_id").where(common.fold(F.col("doc_id"), 3) == 1).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98


def test_no_letters_is_undetermined(spark, docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(docs, F.lit(True)).collect()}
    assert got[2] == got[3] == got[6] == ("und", 0.0)


def test_mixture_of_two_languages():
    own = np.array([langid.trigrams("aaaa")[1], langid.trigrams("bbbb")[1]])
    m = langid.Model.of(["a", "b"], own, np.array([0, 1]), np.array([1e6, 1e6]))
    _, _, shares, _ = m.mixture("a" * 60 + " " + "b" * 30)
    assert abs(shares["a"] - 2 / 3) < 0.1


def plain_mixture(counts, text):
    """counts: by language, of each bucket; expectation-maximisation and the search of a set, without arrays."""
    total = {g: sum(c.values()) + langid.SMOOTH * langid.BUCKETS for g, c in counts.items()}
    grams = [int(x) for x in langid.trigrams(text)]
    p = lambda g, x: langid.NOISE if g is None else (counts[g].get(x, 0) + langid.SMOOTH) / total[g]

    def fitted(names):
        share = dict.fromkeys(names, 1 / len(names))
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(names, 0.0)
            for x in grams:
                whole = sum(share[g] * p(g, x) for g in names)
                for g in names:
                    new[g] += share[g] * p(g, x) / whole / len(grams)
            moved, share = max(abs(new[g] - share[g]) for g in names), new
            if moved < 1e-4:
                break
        return share, sum(math.log(sum(share[g] * p(g, x) for g in names)) for x in grams)

    first, best = fitted([*counts, None])[0], None
    order = sorted(counts, key=lambda g: -first[g])
    for k in range(1, len(order) + 1):
        share, fit = fitted([*order[:k], None])
        if (k > 1 and first[order[k - 1]] < 1e-3) or (best and fit - 0.5 * k * math.log(len(grams) + 1) <= best[0]):
            break
        best = (fit - 0.5 * k * math.log(len(grams) + 1), share)
    return best[1]


@pytest.mark.parametrize("held, at_once", [(256, 1 << 22), (1, 24)])
def test_mixtures_are_those_of_plain_expectation_maximisation(table, monkeypatch, held, at_once):
    """Also with tables passed on after each language, and probabilities made in small blocks."""
    monkeypatch.setattr(langid, "HELD", held)
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    rows = [(r.text, r.lang) for r in table.where("lang is not null and length(text) between 20 and 200").orderBy("doc_id").limit(60).collect()]
    m = langid.learned(table.sparkSession.createDataFrame(rows, "text string, lang string"))
    counts = {g: Counter() for g in m.langs}
    for t, g in rows:
        counts[g].update(int(x) for x in langid.trigrams(t))
    for t in [t for t, _ in rows[:8]] + [rows[0][0] + " " + next(t for t, g in rows if g != rows[0][1])]:
        want = plain_mixture(counts, t)
        _, _, shares, noise = m.mixture(t)
        assert abs(noise - want[None]) < 1e-4 and all(abs(want.get(g, 0) - x) < 1e-4 for g, x in shares.items())


def test_a_thousand_languages(spark):
    rows = [(f"{chr(0x4E00 + i)}{chr(0x4E01 + i)}{chr(0x4E02 + i)}" * 3, f"l{i:04d}") for i in range(0, 3000, 3)]
    d = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r.lang_pred for r in langid.identified(d, F.lit(True)).collect()}
    assert sum(got[i] == g for i, (_, g) in enumerate(rows)) > 990


def test_sampling_estimates_jaccard(table):
    texts = [r.text for r in table.orderBy("doc_id").limit(40).collect()]
    errors = []
    for a, b in zip(texts, texts[1:]):
        e = cws.edited(a, b)
        x, y = (dict(zip(*(v.tolist() for v in cws.terms(t)))) for t in (a, e))
        keys = x.keys() | y.keys()
        exact = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(1, sum(max(x.get(k, 0), y.get(k, 0)) for k in keys))
        errors.append(cws.likeness(cws.signature(a), cws.signature(e)) - exact)
    assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.1


@pytest.mark.parametrize("kind, key", [("string", "k{:03d}".format), ("double", lambda i: i / 7), ("date", lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i))])
def test_sampling_takes_keys_of_any_type(spark, kind, key):
    """Null keys last; rows of one key by their text's hash."""
    rows = [(key(i // 2), f"a b {i} c" * 3) for i in range(120)] + [(None, f"x {i}") for i in range(50)]
    d = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    order = [r.text for r in d.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]
    want = Counter(hashlib.sha256(cws.edited(t, n).encode()).hexdigest() for t, n in zip(order, order[1:] + order[:1], strict=True))
    assert Counter(r.edited_sha256 for r in cws.edit_study(d).collect()) == want


def test_edits_take_the_next_document(spark, table):
    x = table.toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    following = [*x.text[1:], x.text[0]]
    want = {i: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for i, t, n in zip(x.doc_id, x.text, following)}
    assert dict(cws.edit_study(table).select("doc_id", "edited_sha256").collect()) == want


def test_hmm_base_scores_and_gain(spark, table):
    got = hmm.scored(table, common.fold(table.doc_id, 5) != 1).toPandas()
    tokens = {r.doc_id: r.text.encode().lower().split() + [b""] for r in table.collect()}
    counts = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in got.itertuples():
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6
    assert got.score.sum() > got.base_score.sum()


def test_scaled_forward_is_exact():
    rng = np.random.default_rng(0)
    start, trans, emit = hmm.initial(np.full(hmm.CLASSES, 1 / hmm.CLASSES))
    seqs = [rng.integers(0, hmm.CLASSES, n) for n in (1, 5, 64, 65, 200)]

    def plain(x):
        v, log = start, 0.0
        for c in x:
            v = (v @ trans) * emit[:, c]
            log += np.log(v.sum())
            v = v / v.sum()
        return log

    assert np.allclose(hmm.likelihoods(seqs, start, trans, emit), [plain(s) for s in seqs])
    begin, moves, emitted, _ = hmm.expected(seqs, start, trans, emit, np.full(hmm.CLASSES, 1 / hmm.CLASSES), start)
    assert np.isclose(begin.sum(), 5) and np.isclose(moves.sum(), 335) and np.isclose(emitted.sum(), 335)


def test_simhash_components(spark, table):
    x = table.toPandas()
    fps = np.array([simhash.majority(simhash.shingle_hashes(common.words_of(t), 3)) for t in x.text], np.uint64)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(x.doc_id):
        least[find(i)] = min(k, least.get(find(i), k))
    want = {k: (f"{fps[i]:016x}", least[find(i)]) for i, k in enumerate(x.doc_id)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(table).collect()}
    assert got == want


def test_links_reach_two_bits_and_no_more(spark):
    base = 0x0123456789ABCDEF
    rows = [base, base ^ 3, base ^ (1 << 40) ^ 1, base ^ (5 << 33), base ^ 7]
    f = spark.createDataFrame([(r,) for r in rows], "fp long")
    roots = {r.node: r.root for r in common.components(simhash.links(f)).collect()}
    assert len({roots[r] for r in rows}) == 1  # the last is three bits from the first, one from the second
    far = spark.createDataFrame([(0,), (7,)], "fp long")
    assert simhash.links(far).count() == 0


def test_near_copies_keep_one(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows = [(1, " ".join(words))]
    for k in range(2, 8):
        w = list(words)
        for i in rng.integers(0, 400, 5):
            w[i] = "new"
        rows.append((k, " ".join(w)))
    rows += [(20 + k, " ".join(f"v{i}" for i in rng.integers(0, 5000, 400))) for k in range(5)]
    d = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows + rows[-1:]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in simhash.deduplicated(d).collect()) == [1, 20, 21, 22, 23, 24]


def test_mixing_by_brute_force(spark):
    import compare

    con = compare.connection("/root/testdata/sf0.01")
    assert compare.differences(spark, con, queries.op9_source_mix, queries.SQL["op9_source_mix"], "/root/testdata/sf0.01") == ""


def test_mix_repeats_documents(spark, table):
    taken = {r.doc_id: r.taken for r in mixing.shares(table).collect()}
    sizes = {r.doc_id: len(r.text.encode().split()) for r in table.collect()}
    assert all(t <= 3 * sizes[k] for k, t in taken.items())
    mixed = Counter(r.doc_id for r in mixing.mixed(table).collect())
    assert {k: t // max(1, sizes[k]) for k, t in taken.items() if t} == {k: n for k, n in mixed.items() if sizes[k]}


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(RULES.items()) for m in re.finditer(p, text or "") if ok(k, m[0]))
    return ",".join(f"{list(RULES)[i]}:{a}:{b}" for a, i, b in found)


def test_rules_by_brute_force(spark, table):
    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "4111 1111-1111 1111", "+1 (234) 555-6789...", "é😀 a@b.co 10.0.0.1", "+1+1 234 567 890", "a@b.c.d..e@f.g " * 300, "9" * 20000, ".".join("1" * 5000), "a" * 20000]
    texts = [*odd, *(r.text for r in table.collect())]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(pii.personal(d).select("doc_id", "base_sha256").collect())
    assert got == {i: hashlib.sha256(plain_spans(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_bootstrap_finds_what_rules_miss(spark):
    good = ["4111111111111111", "4012888888881881", "5555555555554444", "5105105105105100", "378282246310005", "4222222222222", "6011111111111117", "4000056655665556"]
    rows = [(i, f"her card {c} was used") for i, c in enumerate(good)] + [(100, "his card 4111111111111112 failed"), (101, "the year 12345 ended")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal(d).collect()}
    assert got[100] == "found:9:25" and got[0] == "card:9:25"
    new = {r.doc_id: r.text for r in pii.redacted(d).collect()}
    assert new[100] == "his card <FOUND> failed" and new[0] == "her card <CARD> was used"


def test_pipeline_stages(spark, table):
    import corpus_pipeline as c

    docs, columns = table, table.columns
    seen = []
    for name, stage in c.STAGES:
        docs = common.written(stage(spark, docs, SF))
        seen.append(docs.count())
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "personal_data":
            assert not any(plain_spans(r.text) for r in docs.collect())
    assert seen[0] >= 0.95 * table.count() and seen[1] < seen[0] and seen[2] == seen[1]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_near_duplicates_in_large_buckets(spark):
    """Edited copies of an absent original, and unlike texts around a shared passage with a few copies among them:
    groups are the components of all pairs of a similarity of 4/5 or more."""
    r = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in r.integers(0, 50000, n)]
    original, passage, texts = word(200), word(120), []
    for i in range(70):
        copy = list(original)
        for at in r.choice(200, 2 + i % 3, replace=False):
            copy[at] = f"edit{i}x{at}"
        texts.append(copy)
    for i in range(70):
        own = passage + word(60)
        texts.append(own)
        if i % 10 == 0:
            texts.append(own[:-1] + ["other"])
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(zip(*(t[i:] for i in range(5)))) for t in texts]
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    group = np.arange(len(texts))
    while True:
        least = np.where(near, group[None], len(texts)).min(1)
        if (least == group).all():
            break
        group = least
    got = {r.key: r.group for r in jaccard.duplicates(frame).collect()}
    assert got == dict(enumerate(group.tolist()))
    assert 10 < len(set(got.values())) < len(texts)
