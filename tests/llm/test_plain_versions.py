"""Queries against plain versions of their contracts, and odd rows in every stage of the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import NASTY, ROWS, SF, plain_spans

from tracklane.llm import common, cws, media, mixing, pii, queries, simhash


def mix(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.shares(d).collect()
    taken = {}
    for r in mixing.mixed(d).collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    assert all(r.taken <= 3 * r["size"] for r in got) and len(got) == len(rows)
    return got, taken


def test_one_source_is_taken_once(spark):
    got, taken = mix(spark, [(i, "a b c " * (i % 5), "s") for i in range(40)])
    assert all(r.taken == r["size"] for r in got) and taken["s"] == sum(r["size"] for r in got)


def test_a_source_at_its_cap_is_taken_three_times(spark):
    got, taken = mix(spark, [(i, "a b c d e", "s0") for i in range(1000)] + [(2000 + i, "a b c d", "s1") for i in range(100)])
    assert {r.taken for r in got if r.source_size == 400} == {12} and taken == {"s0": 4200, "s1": 1200}


def test_repeated_rows_of_null_keys_come_near_the_target(spark):
    got, taken = mix(spark, [(None, "a b c d e", "s0")] * 200 + [(i, "x y z", "s1") for i in range(400)])
    for size, source in ((1000, "s0"), (1200, "s1")):
        own = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 and sum(r.taken for r in own) == taken[source]


def test_a_cut_of_many_rows_is_cut_again(spark, monkeypatch):
    import compare

    monkeypatch.setattr(mixing, "SORTED", 5)
    sf = "/root/testdata/sf0.01"
    assert compare.differences(spark, compare.connection(sf), queries.op9_source_mix, queries.SQL["op9_source_mix"], sf) == ""


@pytest.mark.parametrize("hot", [1, 256])
def test_candidates_beyond_two_bits_are_dropped(spark, hot):
    """Fingerprints around one value, most of which share a segment, against all pairs."""
    r = np.random.default_rng(2)
    base, f = 0x0123456789ABCDEF, set()
    for _ in range(300):
        x = base
        for bit in r.choice(64, r.integers(0, 5), replace=False).tolist():
            x ^= 1 << bit
        f.add(x if x < 1 << 63 else x - (1 << 64))
    d = spark.createDataFrame([(x,) for x in f], "fp long")
    far = simhash.candidates(d, hot=hot).select(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("n")).collect()
    assert any(x.n > 2 for x in far)
    u = sorted(f)
    want = {(a, b) for a in u for b in u if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    c = simhash.candidates(d, hot=hot).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    assert {(min(x), max(x)) for x in map(tuple, c.collect())} == want == set(map(tuple, simhash.links(d).collect()))


@pytest.mark.parametrize("hot", [1, 256])
def test_the_index_finds_any_two_bits_by_few_rows(spark, hot):
    """One and two bits at all places around a value; a fingerprint was exploded to up to 66 rows for its lookups."""
    base = 0x0123456789ABCDEF
    signed = lambda x: x if x < 1 << 63 else x - (1 << 64)
    f = {signed(base ^ (1 << i) ^ (1 << j if j < 64 else 0)) for i in range(64) for j in range(i + 1, 65)}
    d = spark.createDataFrame([(signed(base),), *[(x,) for x in f]], "fp long")
    c = simhash.candidates(d, hot=hot)
    assert {x.b if x.a == signed(base) else x.a for x in c.where((F.col("a") == signed(base)) | (F.col("b") == signed(base))).collect()} == f
    assert "transform" not in c._jdf.queryExecution().optimizedPlan().toString()


def test_contexts_find_identifiers_that_no_rule_knows(spark):
    r = np.random.default_rng(9)
    hexed = lambda n: "".join("0123456789abcdef"[i] for i in r.integers(0, 16, n))
    plain = [f"nothing odd in text {i} but the year 1999 and room 4{i:03d}" for i in range(60)]
    seeds = [f"some words then api_key={hexed(20)} and more" for _ in range(20)]
    unseen = ["now api_key=correcthorse follows", "the Api_key=abcdefgh99 again"]
    d = spark.createDataFrame(list(enumerate(plain + seeds + unseen)), "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.personal(d).collect()}
    assert all(got[i] == "" for i in range(60))  # precision
    assert got[80] == "found:12:24" and got[81] == "found:12:22"  # recall
    assert sum("found" in got[i] for i in range(60, 80)) == 20


def test_personal_data_counts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {x.doc_id: x.text for x in d.collect()}
    for x in pii.personal(d).collect():
        want = plain_spans(texts[x.doc_id])
        kinds = [s.split(":")[0] for s in want.split(",") if s]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(x.spans.split(","))


def test_media_digests(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {x.doc_id: (x.text or "").encode() for x in d.collect()}
    got = queries.op4_media(spark, SF).collect()
    assert len(got) == len(texts)
    for x in got:
        raw = texts[x.doc_id]
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.write_avi(media.encode_frames(payload))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (x.tail_crc32, x.media_bytes, x.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())


def test_fingerprints_and_likeness(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((x.doc_id, x.text or "") for x in d.collect()), reverse=True)
    got = {x.doc_id: x for x in cws.edit_study(d).collect()}
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        e, x = cws.edited(t, after), got[k]
        a, b, c = map(cws.signature, (t, e, after))
        assert (x.n_chars, x.fingerprint, x.edited_fingerprint) == (len(t), cws.hexed(a), cws.hexed(b))
        assert (x.near_edited, x.near_next) == ((a == b).mean(), (a == c).mean())


def test_rules_of_urls(spark):
    sf = "/root/testdata/sf0.01"
    urls = {x.page_id: x.url for x in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    for x in queries.op1_url_filter(spark, sf).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[x.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (x.host, x.path, x.rule) == (host, path, best[1]) and x.verdict in ("allow", "block") and best[2] in (None, x.verdict)


def test_every_stage_takes_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names; each stage by itself."""
    import corpus_pipeline as c

    schema = NASTY + ", __n int, __k int, __h int, row int, k int, t int, n int, h2 int, copy int, new int, spans int, src int, tie int, epochs int"
    docs = common.written(spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[0] * 6, 0.0, 0, 0, "z", *[1] * 14) for r in ROWS], schema))
    want = {"language_id": (7, 10), "simhash_dedup": (7, 7), "personal_data": (10, 10), "source_mix": (8, 30), "best_fit_packing": (10, 100)}
    for name, stage in c.STAGES:
        out = stage(spark, docs, SF)
        low, high = want[name]
        assert low <= out.count() <= high, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
    kept = sorted(str(r.text)[:5] for r in c.STAGES[1][1](spark, docs, SF).collect())
    assert len(kept) == len(set(kept)) == 7  # one of null and empty, one of the three equal texts


def test_url_rules_are_those_of_a_plain_version(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))

    urls = dict(queries.table(spark, SF, "pages").select("page_id", "url").collect())
    got = queries.op1_url_filter(spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, said = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, said or ("allow" if r.allow_score >= 0.5 else "block"))
