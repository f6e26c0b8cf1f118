"""Main text, phrases and conversation repair against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from html.parser import HTMLParser

import compare
import duckdb
import pytest

from tracklane.llm import maintext, phrases, queries, repair

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_phrases", "op13_conversation_repair"])
def test_same_rows_as_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare.differences(spark, compare.connection(sf), queries.QUERIES[name], queries.SQL[name], sf) == ""


# phrases


def plain_phrases(rows, least, top, within):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = collections.defaultdict(list)
    candidates = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    inside = collections.defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= within * a and inside[lang, w]:
            continue
        score, _, left, right = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for lang, x in found.items() for i, (score, a, p, left, right) in enumerate(sorted(x)[:top]))


def prose(r, rows, words):
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!?"]
    out = []
    for _ in range(rows):
        lang = r.choice(["x", "y", None, "und"])
        text = "".join(r.choice(words) + r.choice(ends) for _ in range(r.randrange(0, 60)))
        out.append((lang, text + " A b C d" * r.randrange(3)))
    return out + [out[0]] * 5 + [(None, None), ("x", ""), ("y", " .\n"), ("z", "one")]


@pytest.mark.parametrize("limits", [{}, {"WORDS": 0, "JOINED": 7}, {"BLOCK": 50, "KEYS": 20}])
def test_phrases_are_those_of_a_plain_count(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(phrases, k, v)
    rows = prose(random.Random(3), 120, ["a", "B", "b", "c", "é", "É", "a-b", "w" * 40, "\x85", "the", "of"])
    d = spark.createDataFrame([(*r, 1, "q") for r in rows], "lang string, text string, n long, phrase string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(d, 4, 25).collect()))
    assert got == plain_phrases(rows, 4, 25, 80) and len(got) > 50


def test_runs_over_edges_of_ranges_are_added_up(spark, monkeypatch):
    """One phrase is most of the table, and ranges are cut inside its run."""
    monkeypatch.setattr(phrases, "KEYS", 3)
    rows = [("x", f"p q r{i % 7} s{i % 5} " * 3) for i in range(60)]
    d = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert sorted(map(tuple, phrases.collocations(d, 2).collect())) == plain_phrases(rows, 2, 2000, 80)


def test_phrases_of_nothing(spark):
    d = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(d).collect() == []
    d = spark.createDataFrame([("x", "a b c")], "lang string, text string")
    assert phrases.collocations(d).collect() == []


def test_a_long_piece_is_worked_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 64)
    rows = [("x", "a b c d e " * 500)]
    got = sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 30).collect()))
    assert got == plain_phrases(rows, 30, 2000, 80)


# repair


def fault_flags(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """All edits, by states; rows are sorted."""
    faults = fault_flags(rows)

    def inserted(states):
        for _ in range(4):
            for s, (c, a, out) in list(states.items()):
                to, role = (3, "assistant") if s == 2 else (2, "user")
                if to not in states or (c + 3, a + "I") < states[to][:2]:
                    states[to] = (c + 3, a + "I", [*out, role + ":"])
        return states

    states = inserted({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def offer(s, c, a, out):
            if s not in after or (c, a) < after[s][:2]:
                after[s] = (c, a, out)

        for s, (c, a, out) in states.items():
            offer(s, c + 4, a + "D", out)
            if fault in ("b", "d"):
                continue
            more = 3 if fault == "t" else 0
            for kind, cost, new in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                if new[:1] == "s" and kind == "K" and s == 0:
                    offer(1, c + more, a + kind, [*out, f"{new}:{text}"])
                if new[:1] == "u" and s != 2:
                    offer(2, c + cost + more, a + kind, [*out, f"{new}:{text}"])
                if new[:1] == "a" and s == 2:
                    offer(3, c + cost + more, a + kind, [*out, f"{new}:{text}"])
        states = inserted(after)
    c, a, out = min((states[s] for s in (0, 3) if s in states), key=lambda x: x[:2])
    turns = {t for t, *_ in rows if t is not None}
    pairs = [x[1][:1] + y[1][:1] for x, y in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), c, a, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_result(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {c: plain_repair(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))) for c, r in convs.items()}


def talk(r, convs, most):
    rows = []
    for c in range(convs):
        for _ in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ustad"])
            rows.append((r.choice([c, c, c, None]), r.choice([None, *range(8)]), role, r.choice(["a.", "b!", "c", "d?\n", "", " \x0b", None, "é .", "e", "f."])))
    return rows


@pytest.mark.parametrize("most", [512, 3])
def test_repairs_are_those_of_a_plain_search(spark, most):
    rows = talk(random.Random(5), 60, 14)
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conv long")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(d, most=most).collect()}
    assert got == plain_result(rows)


def test_a_best_audit_is_the_least_of_all_edits(spark):
    """Every sequence of edits, written out, of short conversations."""
    r = random.Random(8)
    for _ in range(12):
        rows = [(i, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "c!", ""])) for i in range(r.randrange(0, 5))]
        faults, best = fault_flags(rows), None
        kinds = [["D"] if f in ("b", "d") else ["K", "Ru", "Ra", "D"] for f in faults]
        for edits in itertools.product(*kinds):
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                roles, audit, cost = "", "", 0
                for i in range(len(rows) + 1):
                    roles, audit, cost = roles + gaps[i], audit + "I" * len(gaps[i]), cost + 3 * len(gaps[i])
                    if i < len(rows):
                        e = edits[i]
                        audit += e[0]
                        cost += {"K": 0, "R": 3, "D": 4}[e[0]] + (3 if faults[i] == "t" and e != "D" else 0)
                        roles += "" if e == "D" else rows[i][1][0] if e == "K" else e[1]
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert plain_repair(rows)[5:7] == best


def test_damage_is_that_of_the_contract(spark):
    rows = talk(random.Random(9), 80, 6)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want, named = [], {c for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        new = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [] if k == 0 else [new, new] if k == 3 else [new]
    got = repair.damaged(d)
    order = lambda x: [(v is not None, v or 0) if i < 2 else v for i, v in enumerate(x)]
    assert sorted((tuple(r)[:4] for r in got.where("present").collect()), key=order) == sorted(want, key=order)
    result = {r.conv_id: tuple(r)[1:] for r in repair.repaired(got, present="present").collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result == {c: empty for c in named} | plain_result(want)


def test_one_conversation_of_equal_turns(spark):
    """Equal turns are one row with a number; a conversation far longer than an array may be."""
    rows = [(1, 3, "user", "a.")] * 300 + [(1, 4, "assistant", "b.")] * 2 + [(1, i, "user", "x.") for i in range(40)] + [(2, 1, "user", None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(d, most=5).collect()}
    assert got == plain_result(rows)


def test_no_conversations(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(repair.damaged(d), present="present").collect() == []


# main text


class Article(HTMLParser):
    """Blocks inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.pieces = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if self.inside and tag in ("p", "h1", "article"):
            self.pieces.append("")

    def handle_endtag(self, tag):
        if self.inside and tag in ("p", "h1"):
            self.pieces.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.pieces[-1] += data


def test_pages_give_their_articles(spark):
    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    want = {}
    for i, url, page in rows:
        a = Article()
        a.feed(page)
        a.close()
        text = "\n\n".join(t for t in (" ".join(p.split()) for p in a.pieces) if t)
        want[i] = (url, text, len(text))
    got = {r.page_id: tuple(r)[1:] for r in queries.op11_main_text(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<article><h1>A &amp; B&nbsp;C</h1><p>x <b>y</b>\n z<br>w<p>next &am &#x41;&lt;b&gt;</article>", "A & B C\n\nx y z w\n\nnext &am A<b>"),
        ("<header><h1>Site</h1></header><main><header><h1>Title</h1><span>by me</span></header><p>body</p><footer>f</footer></main>", "Title\n\nbody"),
        ("<div class='sidebar'>s</div><article><p>a<script>var x='</p>';</script> b<div class='cookie-notice'>c</div>d</article>", "a b\n\nd"),
        ("<article><p>a</p><section id=comments><article>mine</article></section><form>f<p>g</form></article>", "a"),
        ("<div class='page with-sidebar'><main><p>kept</p></main></div><aside><p>gone</aside>", "kept"),
        ("<article>a < b <!-- no > --> c <p title='x>y'>d</p></article", "a < b c\n\nd"),
        ("<nav>menu<p>more</nav><div role='main'><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></div>", "one\n\ntwo\n\n1 2"),
        ("<article><p>a<style>p{}</style><p hidden>h</p><p style='display: none'>i</p><textarea>t</textarea>b", "a\n\nb"),
        ("<article><p>x<a href='q\">y</a>", "xy"),
        ("<article>a<script>never closed <p>b", "a"),
    ],
)
def test_blocks_of_markup(page, text):
    found = maintext.blocks(page)
    article = [t for k, t in found if k == maintext.ARTICLE]
    assert "\n\n".join(article or [t for k, t in found if k == maintext.NEUTRAL]) == text


def plain_repeats(streams):
    """Beginnings of LENGTH words, with the number of streams that have them."""
    n = collections.Counter()
    for s in streams:
        n.update({tuple(s[i : i + maintext.LENGTH]) for i in range(len(s) - maintext.LENGTH + 1)})
    return n


def test_suffix_arrays_find_all_repeats():
    import numpy as np

    r = random.Random(4)
    streams = [np.array([r.randrange(3) for _ in range(r.randrange(0, 60))], np.uint64) for _ in range(40)]
    h, n = maintext.repeats(streams)
    want = plain_repeats([s.tolist() for s in streams])
    by = {int(maintext._beginnings(np.array(k, np.uint64))[0]): v for k, v in want.items()}
    assert dict(zip(h.tolist(), n.tolist(), strict=True)) == by
    order, new = maintext.suffix_order(streams[3], 8)
    tails = [tuple(streams[3][i : i + 8].tolist()) for i in order]
    assert tails == sorted(tails) and [a != b for a, b in itertools.pairwise(tails)] == new[1:].tolist()


def test_unmarked_pages_lose_what_their_host_repeats(spark, monkeypatch):
    monkeypatch.setattr(maintext, "SLICE", 40)
    menu = "<div><p>Home</p><p>About us</p><p>All our products</p><p>Terms of use and privacy</p></div>"
    foot = "<div>All rights reserved by the owners of this site since 1999</div>"
    own = lambda i: "<div>" + "".join(f"<p>w{i}x{j} stands here and nowhere else in page {i} of them at all</p>" for j in range(3)) + "</div>"
    rows = [(i, "http://One.example/a", menu + own(i) + foot) for i in range(6)]
    rows += [(10, "http://two.example", menu + own(10) + foot), (11, None, menu), (12, "http://one.example", None)]
    rows += [(13, "http://three.example/", own(13))] * 5  # copies count as one page
    rows += [(14, "http://one.example/x", f"<article><p>kept</p></article>{foot}"), (15, "http://one.example", f"<article>{menu}</article>")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = collections.defaultdict(set)
    out = maintext.main_text(d).collect()
    for r in out:
        got[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    text = lambda i: "\n\n".join(f"w{i}x{j} stands here and nowhere else in page {i} of them at all" for j in range(3))
    whole = "Home\n\nAbout us\n\nAll our products\n\nTerms of use and privacy"
    assert len(out) == len(rows)
    assert got == {i: {text(i)} for i in range(6)} | {10: {f"{whole}\n\n{text(10)}\n\nAll rights reserved by the owners of this site since 1999"}, 11: {whole}, 12: {""}, 13: {text(13)}, 14: {"kept"}, 15: {whole}}


def test_articles_lose_what_their_host_repeats_outside_of_articles(spark):
    """A notice that a page leaves inside its article; what articles alone repeat, and an article of nothing else, stay."""
    note = "<p>All rights reserved by the owners of this site since 1999</p>"
    line = "<p>Sung to the tune that everyone in this valley knows by heart</p>"
    rows = [(i, "http://one.example/", f"<article><p>text {i}</p></article><footer>{i}{note}</footer>") for i in range(3)]
    rows += [(3, "http://one.example/b", f"<main><p>mine</p>{note}{line}</main>"), (4, "http://two.example/", f"<main><p>mine</p>{note}</main>"), (5, "http://one.example/", f"<article>{note}</article>")]
    rows += [(i, "http://one.example/", f"<article><p>song {i}</p>{line}</article>") for i in range(6, 10)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = lambda s: s[3:-4]
    want = {i: f"text {i}" for i in range(3)} | {3: f"mine\n\n{plain(line)}", 4: f"mine\n\n{plain(note)}", 5: plain(note)}
    assert {r.page_id: r.text for r in maintext.main_text(d).collect()} == want | {i: f"song {i}\n\n{plain(line)}" for i in range(6, 10)}


def test_no_pages(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    assert maintext.main_text(d).collect() == []
