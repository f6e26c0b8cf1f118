"""The bootstrap: what it may find, and what it must leave."""

import random
import re

from pyspark.sql import functions as F

from tracklane.llm import pii


def found(spark, texts):
    """Words that the bootstrap adds, by document."""
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in pii.personal(d).collect():
        out[r.doc_id] = [texts[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "found"]
    return out


def hexes(r, n):
    return ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)]


def test_slugs_hashes_part_numbers_dates_and_urls_are_left(spark):
    """Alone, and beside secrets, cards and addresses that are found."""
    r = random.Random(1)
    plain = [f"see {s}-holiday-{y} now" for s in ("summer", "winter", "spring") for y in range(2018, 2024)]
    plain += [f"fixed in commit {h} by us" for h in hexes(r, 12)]
    plain += [f"order part {p} from stock" for p in ("ab12-cd34-ef50-gh78", "ab13-cd35-ef51-gh79", "zz99-yy88-xx77-ww66", "qq11-rr22-ss33-tt44")]
    plain += [f"on 2024-{m:02d}-11T10:00:00Z it rained" for m in range(1, 10)] + [f"at https://site{k}.example.org/a/{k}{k}1-long-title-{k}2 read" for k in range(8)]
    plain += [f"room 40{k:02d} of 12 34567{k}" for k in range(10)] + ["MAINTENANCE-WINDOW", "version=12.4.5678", "size: 1234567"]
    assert not any(found(spark, plain).values())
    secrets = [f'set token = "{h}" there' for h in hexes(r, 10)] + [f"her card {c} was used" for c in ("4111111111111111", "4012888888881881", "5555555555554444", "5105105105105100")]
    secrets += [f"write to user{k}@mail{k}.example.com soon" for k in range(5)]
    got = found(spark, plain + secrets)
    assert not any(got[i] for i in range(len(plain)))
    assert all(len(got[len(plain) + i]) == 1 for i in range(10))


def test_unknown_identifiers_of_three_forms_are_found(spark):
    """Keys in a context that seeds taught, numbers that fail the checksum among cards, and secrets of a name that is
    no seed's, met where known ones stand: nine planted in a hundred documents, with decoys of like form."""
    r = random.Random(2)
    h = hexes(r, 60)
    texts = [f'config has token = "{x}" in it' for x in h[:20]] + [f"please deploy with {x} today or later" for x in h[:12]]
    cards = ["4111111111111111", "4012888888881881", "5555555555554444", "5105105105105100", "6011111111111117", "4000056655665556", "4242424242424242", "5200828282828210"]
    texts += [f"paid by card {c} last week" for c in cards] + [f"mine says passcode={x} for all" for x in h[4:14]]
    keys, numbers, codes = h[20:24], ["4111111111111112", "5555555555554440"], h[24:27]
    planted = len(texts)
    texts += [f"please deploy with {x} today or later" for x in keys] + [f"paid by card {c} last week" for c in numbers] + [f"mine says passcode={x} for all" for x in codes]
    texts += [f"merged commit {x} into main" for x in h[30:50]] + [f"item 41111111{k:08d} in the list" for k in range(12)]
    got = found(spark, texts)
    want = [*keys, *numbers, *codes]
    assert [got[planted + i] for i in range(len(want))] == [[w] for w in want]  # recall 1
    extra = {w for i, ws in got.items() for w in ws if i >= planted + len(want)}
    assert not extra  # precision 1: no decoy
    every = {w for ws in got.values() for w in ws}
    assert every <= {*want, *h[:20]} and len(every) >= len(want) + 19  # a rule knows one, by the card number in it


def test_seeds_are_secrets_by_name(spark):
    texts = ["token: abc12345x", "api_key=ABCDEF123", "my-password = pass word1", 'SECRET_KEY="k3yk3yk3y"', "nottoken: abc12345y", "size=123456789x", "token: short1", "Passwd: longenough"]
    got = found(spark, texts)
    assert [got[i] for i in range(len(texts))] == [["abc12345x"], ["ABCDEF123"], [], ["k3yk3yk3y"], [], [], [], []]


def test_rounds_reach_a_fixed_point_by_plain_loops(spark):
    """Confidences of all words against the same rules in plain Python."""
    r = random.Random(3)
    rows = []
    for _ in range(300):
        word = f"{r.choice(['ab', 'cd'])}{r.randrange(40):04d}{r.choice(['', 'X'])}"
        rows.append((word, r.choice(["k=", "at", "of"]), r.choice(["was at", "one of"]), r.choice(["now", ""]), int(word[2:6]) % 3 == 0))
    d = spark.createDataFrame(rows, "word string, left string, left2 string, right string, seed boolean")
    got = {x.word: round(100 * x.confidence) for x in pii.bootstrap(d).collect()}
    edges, seeds = {}, {}
    pats = d.distinct().select("word", "seed", F.explode(pii.patterns(*map(F.col, ("word", "left", "left2", "right")))).alias("p")).collect()
    for x in pats:
        edges.setdefault(x.p, set()).add(x.word)
        seeds[x.word] = seeds.get(x.word, False) or x.seed
    p = {w: 100 * s for w, s in seeds.items()}
    while True:
        q = {k: sum(p[w] for w in ws) // (len(ws) + 1) for k, ws in edges.items() if sum(p[w] > 0 for w in ws) >= 3}
        q = {k: v for k, v in q.items() if v >= 60}
        new = {}
        for w in p:
            mine = [k for k in q if w in edges[k]]
            kinds = {k.split(" ")[0] for k in mine}
            new[w] = max([p[w], *[q[k] for k in mine]]) if len(kinds) > 1 and kinds - {"form", "head"} else p[w]
        if new == p:
            break
        p = new
    assert got == {w: v for w, v in p.items() if v > 0}
    assert re.match("ab|cd", next(iter(got))) and len(got) < len(p)
