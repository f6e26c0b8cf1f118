"""Main text of pages: markup where it tells, and a host's suffix array where it doesn't.

A page's blocks are sorted by markup into its article (article, main and their like), boilerplate that says so (menus,
headers, footers, sidebars, notices, adverts, forms, comments by element, class, id or role) and open blocks. What then
counts is repetition: the words of all blocks outside of articles are a page's stream; streams of a host are
concatenated, their suffixes sorted to the depth of LENGTH words by prefix doubling, and neighbours in that order that
begin with the same LENGTH words on several distinct pages are boilerplate. Equal streams count as one page, so that
copies of a page don't erase it. Blocks mostly covered by such runs are removed, those of an article (on a page that
marks one) or open ones; the others are the text. What repeats between articles alone is text: copies of an article,
quotations and licence lines. So is an article of which nothing would be left.

Suffixes are sorted in slices of a host's streams, so that a large host is no one task's; each slice gives a row for each
distinct beginning, with the number of its pages, and the rows of slices are added up.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, dropped, mixed, word_hashes, word_spans, written

#: Words that a repeated run has at least, and distinct streams of the host that it has to be on.
LENGTH, PAGES = 8, 3
#: An open block goes if this share of its words is covered.
COVERED = 0.5
#: Words of a slice's suffix array.
SLICE = 1 << 20
#: Bits, and those of a part, of the filter that tells tasks which beginnings may be boilerplate (8 MB).
BITS, PART = 1 << 26, 1 << 16

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe noembed noframes textarea title xmp".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul video audio canvas object template svg button".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose end tag closes what is open inside; an end tag of p, li and inline elements doesn't reach beyond them.
HOLDS = BLOCK - HEADINGS - {"p", "li", "dd", "dt"}
ASIDE = set("head nav footer aside form menu dialog template svg math canvas object button select datalist audio video search".split())
#: Parts of class, id and role that name boilerplate. What comes first gives way to an article inside it.
FRAME = set("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar complementary contentinfo toolbar topbar skip notice notices".split())
EXTRA = set("ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay alert form search login signup newsletter subscribe subscription comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations trending pagination pager widget".split())
MAIN = {"article", "main"}
#: Elements that say what they are without attributes.
TELLS = MAIN | ASIDE | {"header"}
NEUTRAL, ARTICLE, OUT, OUT_FRAME, HEAD_OF_ARTICLE = range(5)

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
NAMES = re.compile(r"[a-z0-9]+")


def host(url: str | None) -> str:
    """What stands between the first :// and the next /, ?, # or end, A-Z lower-cased."""
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].translate(dict(zip(range(65, 91), range(97, 123), strict=True)))


def _role(name: str, attributes: str, parent: int) -> int:
    if parent == OUT or name in ASIDE:
        return OUT
    named: set[str] = set()
    main = name in MAIN
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                named.update(NAMES.findall(value))
                main |= key == "role" and value == "main"
            elif key == "itemprop":
                main |= value == "articlebody"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                return OUT
    if named & EXTRA and name not in ("html", "body", "main"):
        return OUT
    if main:
        return ARTICLE
    if name == "header" or named & FRAME and name not in ("html", "body"):
        if parent in (ARTICLE, HEAD_OF_ARTICLE):
            return HEAD_OF_ARTICLE if name == "header" else OUT
        return OUT_FRAME
    return parent


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The page's blocks in order: (NEUTRAL, ARTICLE or OUT, text), with character references decoded and white space
    collapsed. Scripts, styles, comments and other markup have no text; what is not closed ends with the page."""
    page = page or ""
    out: list[tuple[int, str]] = []
    inside: list[str] = []
    beside: list[str] = []
    stack: list[tuple[str, int]] = []
    role = here = NEUTRAL

    def flush():
        nonlocal inside, beside
        for pieces, kind in ((inside, here), (beside, OUT)):
            if pieces:
                text = " ".join(markup.unescape("".join(pieces)).split())
                if text:
                    out.append((kind, text))
        inside, beside = [], []

    def text(s: str):
        nonlocal here
        if role in (OUT, OUT_FRAME, HEAD_OF_ARTICLE) and not (role == HEAD_OF_ARTICLE and any(n in HEADINGS for n, _ in stack)):
            beside.append(s)
        else:
            here = ARTICLE if role == HEAD_OF_ARTICLE else role
            inside.append(s)

    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            text(page[at:])
            break
        if i > at:
            text(page[at:i])
        m = TAG.match(page, i)
        if m is None:
            if page.startswith("<!--", i):
                j = page.find("-->", i + 4)
                at = n if j < 0 else j + 3
                continue
            after = page[i + 1 : i + 2]
            if after in ("!", "?") or after == "/" and not page[i + 2 : i + 3].isalpha():
                j = page.find(">", i)
                at = n if j < 0 else j + 1
                continue
            if not (after == "/" or after.isascii() and after.isalpha()):
                text("<")
                at = i + 1
                continue
            j = page.find(">", i)
            if j < 0:  # an unfinished tag ends the page
                break
            at = j + 1
            m = UNQUOTED.match(page[i:at])  # a quote that is not closed
            if m is None:
                continue
        else:
            at = m.end()
        name = m[2].lower()
        if m[1]:
            if name in BLOCK and (inside or beside):
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name not in HOLDS and stack[k][0] in HOLDS:
                    break
            role = stack[-1][1] if stack else NEUTRAL
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            j = page.find(">", end.end()) if end else -1
            at = n if j < 0 else j + 1
            continue
        if name in BLOCK:
            if inside or beside:
                flush()
            closes = ("li",) if name == "li" else ("dd", "dt") if name in ("dd", "dt") else ()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in HOLDS:
                    break
            role = stack[-1][1] if stack else NEUTRAL
        elif name in ("br", "td", "th", "img"):
            text(" ")
        if name in VOID:
            continue
        own = _role(name, m[3], role) if m[3] or name in TELLS else OUT if role == OUT else role
        if name in BLOCK or own != role:
            stack.append((name, own))
            role = own
    flush()
    return out


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of blocks, and the number of words of each."""
    data = LOWER_BYTES[np.frombuffer("\n".join(t.replace("\n", " ") for t in texts).encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends = word_spans(data) if len(data) else (np.zeros(0, int), np.zeros(0, int))
    words = word_hashes(data, starts, ends)
    edges = np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, edges), prepend=0)


def _key(name: str, words: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(name.encode("utf-8", "surrogatepass") + b"\0" + words.tobytes(), digest_size=16).digest()


def _own(name: str, words: np.ndarray) -> np.ndarray:
    """Word hashes of a host."""
    import hashlib

    return mixed(words ^ np.frombuffer(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64))


def _beginnings(words: np.ndarray) -> np.ndarray:
    """A hash of the LENGTH words that each suffix begins with (suffixes of fewer have none)."""
    n = len(words) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(LENGTH):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : n + i]
        return mixed(h)


def suffix_order(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of words to a depth (a power of two), by prefix doubling, and for each of its entries whether
    it begins otherwise than the one before within that depth."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < depth:
        after = np.zeros(len(rank), np.int64)
        after[: max(len(rank) - k, 0)] = rank[k:]
        rank = np.unique(rank * np.int64(len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    return order, np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1])) if len(order) else np.zeros(0, bool)


def repeats(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of a slice of streams: each distinct beginning of LENGTH words and the number of its streams."""
    long = [s for s in streams if len(s) >= LENGTH]
    if not long:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = np.concatenate(long)
    page = np.repeat(np.arange(len(long)), [len(s) for s in long])
    order, new = suffix_order(words, LENGTH)
    left = np.concatenate([np.arange(len(s), 0, -1) for s in long])  # words up to the end of the stream
    inside = left[order] >= LENGTH
    group = (np.cumsum(new) - 1)[inside]
    order = order[inside]
    pairs = np.unique(group * len(long) + page[order])
    groups, first = np.unique(group, return_index=True)
    h = np.concatenate([np.concatenate((_beginnings(s), np.zeros(LENGTH - 1, np.uint64))) for s in long])
    return h[order[first]], np.bincount(np.searchsorted(groups, pairs // len(long)), minlength=len(groups)).astype(np.int64)


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, words = [], []
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = blocks(page)
            rest = [t for kind, t in found if kind != ARTICLE]
            if rest:
                w = _own(name := host(url), _stream(rest)[0])
                keys.append(_key(name, w))
                words.append(w.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words, pa.list_(pa.int64()))], ["key", "words"])


def _sorted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(streams):
        h, n = repeats(streams)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["beginning", "pages"])

    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        for w in b.column(0):
            held.append(w.values.to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= SLICE:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


def _bit(beginnings: np.ndarray) -> np.ndarray:
    return (beginnings >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def _filter(often: DataFrame) -> np.ndarray:
    """Bytes of BITS bits, of which those of the beginnings are set."""

    def part(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(PART, np.uint8)
        bits[_bit(group["beginning"].to_numpy().view(np.uint64)) % PART] = 1
        return pd.DataFrame({"part": group["part"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((BITS // PART, PART // 8), np.uint8)
    parts = F.shiftrightunsigned("beginning", 64 - (BITS // PART).bit_length() + 1).alias("part")
    for r in often.select(parts, "beginning").groupBy("part").applyInPandas(part, "part long, bits binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _extracted(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Texts of pages on which nothing begins as boilerplate may; blocks, key and such beginnings of the others."""
    for b in batches:
        texts, keys, kept, hits, marked = [], [], [], [], []
        for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            found = blocks(page)
            article = [t for kind, t in found if kind == ARTICLE]
            # on a page that marks an article only its own blocks count
            some = [(True, t) for t in article] or [(kind == NEUTRAL, t) for kind, t in found]
            at = np.zeros(0, np.int64)
            if bits is not None and any(x for x, _ in some):
                w = _own(name := host(url), _stream([t for _, t in some])[0])
                h = _beginnings(w)
                i = _bit(h)
                at = np.flatnonzero(bits[i >> 3] >> (7 - (i & 7)).astype(np.uint8) & 1)
            marked.append(bool(article))
            if len(at):
                texts.append(None)
                keys.append(_key(name, w))
                kept.append([{"open": x, "text": t} for x, t in some])
                hits.append([{"at": i, "beginning": x} for i, x in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True)])
            else:
                texts.append("\n\n".join(t for x, t in some if x))
                keys.append(None)
                kept.append(None)
                hits.append(None)
        shape = pa.list_(pa.struct([("open", pa.bool_()), ("text", pa.string())]))
        begins = pa.list_(pa.struct([("at", pa.int32()), ("beginning", pa.int64())]))
        columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(keys, pa.binary()), pa.array(kept, shape), pa.array(hits, begins), pa.array(marked, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "key", "blocks", "hits", "marked"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for found, places, article in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            sizes = _stream([x["text"] for x in found])[1]
            covered = np.zeros(int(sizes.sum()) + 1, np.int64)
            for at in places or ():
                covered[at] += 1
                covered[at + LENGTH] -= 1
            upto = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] > 0)))
            ends = np.cumsum(sizes)
            share = (upto[ends] - upto[ends - sizes]) / np.maximum(sizes, 1)
            rest = [x["text"] for x, s in zip(found, share.tolist(), strict=True) if x["open"] and s < COVERED]
            texts.append("\n\n".join(rest or (x["text"] for x in found if article)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Rows (key, url, text, n_chars), one per row of pages: the main text of each page, its blocks joined by two line
    ends, and its number of code points.

    Null or empty pages, and pages of nothing but boilerplate, have an empty text; pages without a url are those of one
    host; repeated rows are judged alike and count as one page; a page of any length is read whole; markup that is not
    closed ends with the page; an empty table gives no rows; extra columns are not read. keep takes the paths of the
    tables that the result reads.
    """
    spark, old = pages.sparkSession, []
    keep = [] if keep is None else keep
    p = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), pages[html].alias("html"))
    kind = dict(p.dtypes)["page_id"]
    streams = p.select("url", "html").mapInArrow(_outside, "key binary, words array<long>")
    streams = streams.groupBy("key").agg(F.first("words").alias("words"))
    often = streams.select("words").mapInArrow(_sorted_slices, "beginning long, pages long")
    often = written(often.groupBy("beginning").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= PAGES).select("beginning"), old)
    sent = None if often.isEmpty() else spark.sparkContext.broadcast(_filter(often))
    schema = f"page_id {kind}, url string, text string"
    shape = "key binary, blocks array<struct<open: boolean, text: string>>, hits array<struct<at: int, beginning: long>>, marked boolean"
    found = p.mapInArrow(lambda batches: _extracted(batches, sent and sent.value), f"{schema}, {shape}")
    out = found.where("key IS NULL").select("page_id", "url", "text")
    if sent:
        rest = written(found.where("key IS NOT NULL").drop("text"), old)
        at = rest.groupBy("key").agg(F.first("hits").alias("hits")).select("key", F.inline("hits"))
        covered = at.join(often, "beginning", "left_semi").groupBy(F.col("key").alias("of")).agg(F.collect_list("at").alias("places"))
        rest = rest.join(covered, F.col("key") == F.col("of"), "left")
        out = out.unionByName(written(rest.select("page_id", "url", "blocks", "places", "marked").mapInArrow(_kept, schema), keep))
    dropped(spark, old)
    return out.select(F.col("page_id").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
