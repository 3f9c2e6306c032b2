"""Main text of web pages: markup zones, and a suffix array over the token streams of each host's pages.

A page is cut into blocks, and each block falls into a zone by the elements around it:

* ``article``: inside an article element or a container that is named as the article's body;
* ``doubted``: inside an article, in an element whose id or class holds a word for junk beside others ("share", "notice-period");
* ``junk``: inside navigation, page headers and footers, asides, forms, notices, adverts, comments;
* ``open``: everything else; on a page with a main element, what is inside it.

The visible text of every page, article or not, is a stream of tokens, parted where an article begins or
ends. All suffixes of a host's streams are sorted by their first ``depth`` tokens, and neighbours that
share all of these are a run: a long repeat, known by the pages it is on and those that have it inside and
outside articles. A longer repeat is the union of the runs that begin inside it. Long repeats decide by zone:

* open text, on pages without article text: a stretch goes that two pages have outside articles;
* doubted text: a stretch goes that half of the host's pages have, three at least;
* article text: a stretch goes that half of the host's pages have in articles, three at least, and half as
  many outside them. A passage that stands in articles alone (a mirrored article, a quotation, a licence
  line) belongs to them and stays, and so does one article's beginning that other pages show beside theirs.

In open and doubted text a block too short for that goes only as a whole, with at least ``LEAST_BLOCK``
tokens and on at least half of the host's pages, three or more. Junk is never text: menus differ on every
page. Of pages with article text, open blocks are not the article.

The suffix array of a large host fits no task, so it is sorted in buckets. A window of ``depth`` tokens has
an anchor, the smallest hash of the short windows in it, and equal windows have equal anchors: no run leaves the
bucket of its anchor. Buckets are dealt by ranges of (host, anchor, page), whose bounds can fall inside a bucket, and
what the parts of a run count is added. Suffixes go there as the stretches of text whose windows have one anchor,
and only if the anchor is on several pages: with any other a suffix shares no long beginning.
A page's signature is a hash of its main text: mirrors of a page count as one page.
"""

from __future__ import annotations

import html as charrefs
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store

#: Tokens that neighbours in the suffix array must share to count as a long repeat.
DEPTH = 30
#: Tokens of the shortest block that is boilerplate as a whole, and the distinct pages that it must be on.
LEAST_BLOCK, LEAST_PAGES = 6, 3

# Element names of HTML, and the words that class and id names use for these parts.
RAW = frozenset("script style template noscript iframe object svg math canvas textarea select option datalist title audio video".split())
JUNK = frozenset("nav footer aside form button dialog menu fieldset input label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
JUNK_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside footer header masthead topbar cookie cookies consent gdpr banner notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments commentlist reply replies disqus discussion respond widget pagination pager toolbar".split()
)
BODY_NAMES = frozenset("articlebody article-body article-content article-text post-content post-body post-text entry-content entry-body story-body story-content story-text main-content page-content content-body".split())
#: An open element of these names ends when a sibling that cannot stand in it begins.
CLOSES = {"p": frozenset("p div ul ol dl table section article main nav aside header footer form h1 h2 h3 h4 h5 h6 pre blockquote hr figure address details fieldset".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

#: What can begin a tag or declaration; where a tag ends, ``_Tags`` finds.
_OPENS = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_QUOTE_OR_END = re.compile("[>\"']")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

#: Of these names alone, an article element is not the page's article.
NOT_ARTICLE = frozenset("ad advert advertisement sponsored promo related recommended comment comments reply replies widget".split())
#: Parts of an article's own heading.
HEADING = frozenset("header banner masthead".split())
#: Elements that hold a title, whose names come from its words.
TITLES = frozenset("h1 h2 h3 h4 h5 h6 caption figcaption legend summary th dt".split())
#: What parts of a page are made of: beside a name of junk they make one name with it ("share-buttons", "comment-list").
FURNITURE = frozenset("area bar block box btn button buttons container form frame icons inner label links list outer panel posts section slot tags thread unit wrap wrapper".split())
_STATE_WORDS = ("no-", "has-", "with-", "without-", "is-", "js-has-")

ARTICLE, OPEN, JUNKED, HIDDEN, MAIN, DOUBTED = 0, 1, 2, 3, 4, 5
INSIDE = (ARTICLE, DOUBTED)


def _named(attrs: str) -> tuple[frozenset[str], frozenset[str], bool, bool]:
    """The junk names among an element's attributes, and whether they mark an article's body or something not shown.

    The second set is what counts inside an article, where an id is often made from a title ("side-effects") and a class from
    the subject ("menu-item"): roles, and classes that name nothing but junk.
    """
    junk: set[str] = set()
    inside: set[str] = set()
    body = hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = charrefs.unescape(a or b or c), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif name == "role":
            if (role := value.strip().lower()) in JUNK_ROLES:
                junk.add(role)
                inside.add(role)
            body |= value.strip().lower() == "article"
        elif name == "itemprop":
            body |= value.strip().lower() == "articlebody"
        elif name in ("class", "id"):
            names = _NAME.findall(_CAMEL.sub("-", value).lower().replace("_", "-"))
            body |= any(n in BODY_NAMES for n in names)
            for n in names:
                parts = n.split("-")
                # "site-footer" and "ad-slot" name junk; "has-sidebar" and "content-sidebar-wrap" name what stands around it.
                if not n.startswith(_STATE_WORDS):
                    junk |= {p for p in (parts[0], parts[-1]) if p in JUNK_NAMES}
                if name == "class" and all(p in JUNK_NAMES or p in FURNITURE for p in parts):
                    inside |= JUNK_NAMES.intersection(parts)
    return (frozenset(), frozenset(), body, hidden) if body else (frozenset(junk), frozenset(inside), body, hidden)


class _Tags:
    """The tags of a page, in time linear in its length whatever it holds."""

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, str, str | None, str] | None:
        """(start, end, "/" or "", name or None, attributes) of what begins at ``at`` or after it."""
        while m := _OPENS.search(self.page, at):
            if m[2] is None:
                return m.start(), m.end(), "", None, m[0]
            if m.end() > self.last:
                return None  # no tag can end any more: the rest is text
            end = self.close(m.end())
            return m.start(), end + 1, m[1], m[2], self.page[m.end() : end]
        return None

    def close(self, at: int) -> int:
        """The place of the tag's ``>``, which is not inside quotes; a quote that nothing closes is a character.

        Where all that follow are inside quotes, quotes are no longer heeded on this page.
        """
        k = at
        while self.quoted:
            m = _QUOTE_OR_END.search(self.page, k)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            else:
                other = self.page.find(m[0], m.end())
                k = other + 1 if other >= 0 else m.end()
        return self.page.index(">", at)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """``zoned`` by markup alone, for which doubted text is the article's."""
    return [(ARTICLE if zone == DOUBTED else zone, text) for zone, text in zoned(page)]


def zoned(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order; texts are trimmed with single spaces and not empty.

    Elements left open end with the element around them; an unclosed comment or raw element runs to
    the end. White space is what Python's ``str.split`` takes for it, no-break spaces included. What stands in a
    line of text without being text, such as an image or a script, does not part it.
    """
    out: list[tuple[int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, int]] = []
    zone, piece, at, n = OPEN, [], 0, len(page)

    def flush() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text and zone != HIDDEN:
            out.append((zone, text))

    known: dict[str, tuple[frozenset[str], frozenset[str], bool, bool]] = {}
    plain = frozenset(), frozenset(), False, False
    tags, opened = _Tags(page), Counter()

    blocked: list[int] = []  # places of the open elements that are not inline

    def leave(k: int) -> None:
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]
        while blocked and blocked[-1] >= k:
            blocked.pop()

    while at < n:
        m = tags.next(at)
        if m is None:
            piece.append(charrefs.unescape(page[at:]))
            break
        start, end, slash, tag, attrs = m
        if start > at:
            piece.append(charrefs.unescape(page[at:start]))
        at = end
        if tag is None:
            if attrs.startswith("<![CDATA["):
                piece.append(attrs[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if slash:
            if tag == "br":
                piece.append(" ")
            elif tag not in INLINE:
                flush()
            if opened[tag]:
                k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if stack[k][1] != zone:
                    flush()
                zone = stack[k][1]
                leave(k)
            continue
        if tag == "br":
            piece.append(" ")
            continue
        ends = attrs.rstrip().endswith("/")
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, tags.last + 1) if not ends else None
            if found is not None:
                at = found.end()
            elif not ends:
                at = n
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag not in INLINE:
            flush()
            while stack and tag in CLOSES.get(stack[-1][0], ()):
                zone = stack[-1][1]
                leave(len(stack) - 1)
            if tag in CLOSES["p"] and opened["p"]:
                # A paragraph with inline elements left open inside it ends too, however many they are.
                if blocked and stack[blocked[-1]][0] == "p":
                    zone = stack[blocked[-1]][1]
                    leave(blocked[-1])
        if tag in VOID or ends:
            continue
        if not attrs.strip():
            junk, inside, body, hidden = plain
        elif attrs in known:
            junk, inside, body, hidden = known[attrs]
        else:
            junk, inside, body, hidden = known[attrs] = _named(attrs)
        doubted = False
        if tag in ("html", "body", "main"):
            junk = frozenset()
        elif tag == "article":
            junk &= NOT_ARTICLE
        elif zone in INSIDE:
            doubted = tag not in INLINE and tag not in TITLES and bool(junk - HEADING)
            junk = frozenset() if tag in INLINE or tag in TITLES else inside - HEADING
        new = zone
        if hidden or zone == HIDDEN:
            new = HIDDEN
        elif zone == JUNKED:
            new = JUNKED
        elif tag in JUNK or (tag == "header" and zone not in INSIDE) or junk:
            new = JUNKED
        elif doubted:
            new = DOUBTED
        elif tag == "article" or body:
            new = ARTICLE
        elif (tag == "main" or "main" in attrs and re.search(r"role\s*=\s*[\"']?main", attrs)) and zone == OPEN:
            new = MAIN
        if new != zone:
            flush()
        if tag not in INLINE:
            blocked.append(len(stack))
        stack.append((tag, zone))
        opened[tag] += 1
        zone = new
    flush()
    return out


_PARSED = "page_id long, url string, host string, signature long, wanted int, zones array<int>, texts array<string>"
_ANCHORS = "key long, signature long"
_STRETCHES = "row long, site long, signature long, at int, n int, inside boolean, decides boolean, anchor long, codes binary"
_RUNS = "site long, suffix binary, pages long, inside long, outside long"

#: Tokens whose hashes a task keeps, and stretches that it hands on together.
_MEMO, _TOGETHER = 500_000, 20_000
#: Most bits of the map of shared anchors (16 MB); each has 16 below that.
_BITS = 1 << 27


def _hashed(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


def _codes(tokens: list[str], memo: dict[str, int]) -> np.ndarray:
    """64-bit codes of tokens; any order of the alphabet will do for a suffix array, and this is theirs."""
    if len(memo) > _MEMO:
        memo.clear()
    for t in set(tokens).difference(memo):
        memo[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))


def _anchors(codes: np.ndarray, depth: int) -> np.ndarray:
    """The anchor of the first ``depth`` tokens of every suffix that has so many."""
    if len(codes) < depth:
        return np.empty(0, np.uint64)
    short = (depth + 3) // 4
    grams = np.zeros(len(codes) - short + 1, np.uint64)
    for k in range(short):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - short + 1 + k]
    grams ^= grams >> np.uint64(29)
    return np.lib.stride_tricks.sliding_window_view(grams, depth - short + 1).min(axis=1)


def _streams(zones: list[int], tokens: list[list[str]]) -> Iterator[tuple[bool, int, list[str]]]:
    """(inside an article, place, tokens) of the page's streams: a repeat can run over the blocks of one."""
    at = 0
    for inside, group in itertools.groupby(zip(zones, tokens, strict=True), lambda b: b[0] in INSIDE):
        stream = [t for _, block in group for t in block]
        yield inside, at, stream
        at += len(stream)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (page_id, url, host, html) to pages in blocks, with the zone that holds the main text."""
    for batch in batches:
        rows = []
        for page_id, url, host, page in zip(batch["page_id"], batch["url"], batch["host"], batch["html"], strict=True):
            found = zoned(page)
            zones = {z for z, _ in found}
            wanted = ARTICLE if zones & set(INSIDE) else MAIN if MAIN in zones else OPEN
            main = [t for z, t in found if z == wanted or (wanted == ARTICLE and z in INSIDE)]
            signature = _hashed("\n".join(main or [" ".join(t for _, t in found)]))
            rows.append((page_id, url, host, signature, wanted, [z for z, _ in found], [t for _, t in found]))
        yield pd.DataFrame(rows, columns=["page_id", "url", "host", "signature", "wanted", "zones", "texts"]).astype({"page_id": "Int64"})


def anchors(depth: int):
    """A pandas batch function from parsed pages to the anchors of their suffixes, by site; each once for a stream."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for batch in batches:
            keys, counts, signatures = [], [], []
            for site, signature, zones, texts in zip(batch["site"], batch["signature"], batch["zones"], batch["texts"], strict=True):
                for _, _, stream in _streams(list(zones), [t.split() for t in texts]):
                    if len(stream) >= depth:
                        keys.append(np.unique(_anchors(_codes(stream, memo), depth)).view(np.int64) ^ site)
                        counts.append(len(keys[-1]))
                        signatures.append(signature)
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "signature": np.repeat(signatures, counts)})

    return find


def stretches(depth: int, bits: np.ndarray):
    """A pandas batch function from parsed pages to the stretches that hold the suffixes with an anchor in ``bits``.

    A stretch is the codes of its tokens, four bytes each, so that the order of suffixes as bytes is that of codes; ``n`` suffixes of
    ``depth`` tokens begin in it, from place ``at`` of the page on.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        columns = ["row", "site", "signature", "at", "n", "inside", "decides", "anchor", "codes"]
        for batch in batches:
            out: list[tuple] = []
            for row, site, signature, wanted, zones, texts in zip(*(batch[c] for c in ("row", "site", "signature", "wanted", "zones", "texts")), strict=True):
                for inside, start, stream in _streams(list(zones), [t.split() for t in texts]):
                    if len(stream) < depth:
                        continue
                    codes = _codes(stream, memo)
                    own = _anchors(codes, depth).view(np.int64) ^ site
                    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    ends = np.r_[begins[1:], len(own)]
                    spot = own[begins].view(np.uint64) % np.uint64(64 * len(bits))
                    shared = (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) > 0
                    if not shared.any():
                        continue
                    held = (codes >> np.uint64(32)).astype(">u4").tobytes()
                    for k, end in zip(begins[shared].tolist(), ends[shared].tolist(), strict=True):
                        out.append((row, site, signature, start + k, end - k, inside, inside or wanted != ARTICLE, own[k], held[4 * k : 4 * (end - 1 + depth)]))
                if len(out) >= _TOGETHER:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    return cut


def runs(depth: int):
    """A pandas batch function from a sorted part of the suffix array to runs of neighbours that share ``depth`` tokens.

    In: (site, anchor, suffix, signature, outside) in this order, ``outside`` rows first. Out: (site, suffix, pages, inside, outside), the
    numbers of pages. A run whose bucket reaches the edge of a batch can have other pieces, and counts are to be added: rows of a signature
    are neighbours. Of other buckets, runs on so few pages that they decide nothing are left out.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            before = 0 if last is None else 1
            part = batch if last is None else pd.concat([last, batch], ignore_index=True)
            last = batch.tail(1)
            tokens = np.frombuffer(b"".join(part["suffix"]), ">u4").reshape(len(part), depth)
            site, anchor, signature = (part[c].to_numpy() for c in ("site", "anchor", "signature"))
            equal = tokens[1:] == tokens[:-1]
            lcp = np.where(equal.all(axis=1), depth, equal.argmin(axis=1)) * (site[1:] == site[:-1])
            page = np.r_[True, (lcp < depth) | (signature[1:] != signature[:-1])]
            out = part["outside"].to_numpy(bool)
            article = (~out & (page | np.r_[True, out[:-1]]))[before:]
            page, out = page[before:], out[before:]
            begins = np.flatnonzero(np.r_[True, lcp[before:] < depth])
            pages = np.add.reduceat(page.astype(np.int64), begins)
            inside, outside = np.add.reduceat(article.astype(np.int64), begins), np.add.reduceat((page & out).astype(np.int64), begins)
            site, anchor = site[before:][begins], anchor[before:][begins]
            edge = ((site == site[0]) & (anchor == anchor[0])) | ((site == site[-1]) & (anchor == anchor[-1]))
            kept = edge | (pages >= LEAST_PAGES) | (outside > 1)
            yield pd.DataFrame({"site": site[kept], "suffix": batch["suffix"].to_numpy()[begins[kept]], "pages": pages[kept], "inside": inside[kept], "outside": outside[kept]})

    return scan


def _clean(depth: int):
    """A pandas batch function to the pages' text without the tokens that a deciding run or a common block covers."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for wanted, zones, texts, at, level, common in zip(*(batch[c] for c in ("wanted", "zones", "texts", "at", "level", "common")), strict=True):
                # The level that takes a zone's tokens away.
                least = {ARTICLE: 2, DOUBTED: 1} if wanted == ARTICLE else {wanted: 1}
                if at is None and common is None:
                    out.append(" ".join(t for z, t in zip(zones, texts, strict=True) if z in least))
                    continue
                tokens = [t.split() for t in texts]
                covered = np.zeros(sum(map(len, tokens)), np.int8)
                for k, v in sorted(zip(at, level, strict=True), key=lambda hit: hit[1]) if at is not None else ():
                    covered[k : k + depth] = v
                whole = frozenset() if common is None else frozenset(common)
                kept, place = [], 0
                for k, (zone, block) in enumerate(zip(zones, tokens, strict=True)):
                    own = covered[place : place + len(block)]
                    place += len(block)
                    if zone in least and k not in whole and (left := [t for t, c in zip(block, own, strict=True) if c < least[zone]]):
                        kept.append(" ".join(left))
                out.append(" ".join(kept))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": out})

    return clean


def _suffixes(found: DataFrame, depth: int, *columns: str) -> DataFrame:
    """``columns`` of the suffixes in stretches, with ``at`` and the first ``depth`` tokens as ``suffix``."""
    each = found.select(*columns, "codes", F.col("at").alias("start"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return each.select(*columns, (F.col("start") + F.col("k")).alias("at"), F.substring("codes", 4 * F.col("k") + 1, F.lit(4 * depth)).alias("suffix"))


def suffix_array(found: DataFrame, depth: int) -> DataFrame:
    """(site, anchor, suffix, signature, outside), sorted so within ranges of about ``store.PART_ROWS`` suffixes.

    The signature is a key of the ranges, so that a bucket of many pages is sorted by several tasks and a page's part of it by one.
    """
    n = found.agg(F.sum("n")).first()[0] or 0
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // store.PART_ROWS))
    dealt = found.select("site", "anchor", "signature", (~F.col("inside")).alias("outside"), "at", "n", "codes").repartitionByRange(parts, "site", "anchor", "signature")
    rows = _suffixes(dealt, depth, "site", "anchor", "signature", "outside").select("site", "anchor", "suffix", "signature", "outside")
    return rows.sortWithinPartitions("site", "anchor", "suffix", "signature", F.desc("outside"))


def _shared(parsed: DataFrame, depth: int) -> np.ndarray:
    """A map with the bits of all anchors that several pages of a site have; its size is bounded, and where it is too full
    more suffixes are sorted than need be."""
    own = parsed.select("site", "signature", "zones", "texts").mapInPandas(anchors(depth), _ANCHORS)
    both = own.groupBy("key").agg(F.min("signature").alias("low"), F.max("signature").alias("high")).where("low <> high")
    both = store.materialise(both.select("key"), "html-anchors")
    size = min(_BITS, 1 << max(10, (16 * both.count()).bit_length()))
    spot = F.col("key").bitwiseAND(size - 1)
    words = both.select(F.shiftright(spot, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def _long_repeats(parsed: DataFrame, sites: DataFrame, depth: int) -> DataFrame:
    """(row, at, level): where windows of long repeats that decide begin on pages; level 2 takes article text, 1 doubted or open text."""
    found = parsed.select("row", "site", "signature", "wanted", "zones", "texts").mapInPandas(stretches(depth, _shared(parsed, depth)), _STRETCHES)
    found = store.materialise(found, "html-stretches")
    pieces = suffix_array(found, depth).mapInPandas(runs(depth), _RUNS)
    whole = pieces.groupBy("site", "suffix").agg(F.sum("pages").alias("on"), F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).join(sites, "site")
    most = lambda n: (F.col(n) >= LEAST_PAGES) & (2 * F.col(n) >= F.col("pages"))
    inside = F.when(most("inside") & (2 * F.col("outside") >= F.col("inside")), 2).when(most("on"), 1).otherwise(0)
    levels = whole.select("site", "suffix", inside.alias("inner"), F.when(F.col("outside") > 1, 1).otherwise(0).alias("outer")).where("inner + outer > 0")
    levels = store.materialise(levels, "html-runs")
    hits = _suffixes(found.where("decides"), depth, "row", "site", "inside").join(levels, ["site", "suffix"])
    return hits.select("row", "at", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer")).alias("level")).where("level > 0")


def _undecided(zone, wanted):
    """Whether a block's zone leaves it to repeats if a short block goes."""
    return (zone == DOUBTED) | ((wanted != ARTICLE) & (zone == wanted))


def _common_blocks(parsed: DataFrame, sites: DataFrame) -> DataFrame:
    """(row, block): open and doubted blocks that are boilerplate as a whole."""
    each = parsed.select("row", "site", "signature", "wanted", "zones", F.posexplode("texts").alias("block", "text"))
    each = each.select("row", "site", "signature", "wanted", "block", "text", F.element_at("zones", F.col("block") + 1).alias("zone"))
    each = each.where((F.col("zone") != ARTICLE) & (F.regexp_count("text", F.lit(" ")) >= LEAST_BLOCK - 1))
    each = each.select("row", "site", "signature", "block", _undecided(F.col("zone"), F.col("wanted")).alias("asks"), F.xxhash64("text").alias("hash"))
    # Only sites with a block that asks are looked at.
    each = each.join(sites.where("asks").select("site", "pages"), "site")
    on = each.select("site", "hash", "signature", "pages").distinct().groupBy("site", "hash").agg(F.count(F.lit(1)).alias("on"), F.max("pages").alias("pages"))
    common = on.where((F.col("on") >= LEAST_PAGES) & (2 * F.col("on") >= F.col("pages"))).select("site", "hash")
    return each.where("asks").join(common, ["site", "hash"]).select("row", "block")


def main_text(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html; more are ignored).

    Null or empty html gives an empty text and n_chars 0; a null url is the host ''. Rows of the same
    page_id each get a result. An empty table gives an empty result. A page whose every open token is in
    long repeats or common blocks of its host comes out empty, unless the others have the same main text.
    """
    host = F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://", ""), "^[^/?#]*", 0))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    parsed = store.materialise(source.mapInPandas(_parse, _PARSED).withColumn("row", F.monotonically_increasing_id()).withColumn("site", F.xxhash64("host")).drop("host"), "html-parsed")
    asks = F.exists("zones", lambda zone: _undecided(zone, F.col("wanted")))
    each = parsed.groupBy("site", "signature").agg(F.max(asks).alias("asks"))
    sites = store.materialise(each.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.max("asks").alias("asks")), "html-sites")
    none = F.lit(None).cast("int")
    covered = _long_repeats(parsed, sites, depth).select("row", F.struct("at", "level").alias("hit"), none.alias("block"))
    blocks = _common_blocks(parsed, sites).select("row", F.lit(None).cast(covered.schema["hit"].dataType).alias("hit"), "block")
    cuts = covered.unionByName(blocks).groupBy("row").agg(F.collect_list("hit").alias("hits"), F.collect_list("block").alias("common"))
    cuts = store.materialise(cuts.select("row", F.col("hits.at").alias("at"), F.col("hits.level").alias("level"), "common"), "html-cuts")
    decided = parsed.join(cuts, "row", "left").select("page_id", "url", "wanted", "zones", "texts", "at", "level", "common")
    return decided.mapInPandas(_clean(depth), "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
