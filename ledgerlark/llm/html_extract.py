"""Main text of web pages by the suffixes that pages of a host share.

A page is parsed where it lies into blocks, each with the zone that its markup
gives it.  The token streams of a host's pages make one text; in the order of
its suffixes, those that agree on their first ``RUN`` tokens stand together.
That order is read in a distributed way, by grouping the suffixes of a host by
these tokens, so no task holds a host.  A substring that distinct pages share
is a chain of such suffixes at successive places, of any length from ``RUN``
up.  Blocks that shared substrings cover are boilerplate, and only their
unique runs stay.  Inside a container that a page marks as its article, a
repeated passage is content (an article may stand on two pages), unless it is
a whole block that nearly every page of the host has.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, settle

#: Tokens of the shortest run that counts, block ends included.
RUN = 8
#: Share of a block that repeated runs must cover for the block to go as a whole.
COVERED = 0.8
#: A page is a copy if the blocks that fewest pages share have so many times the words that are its own.
COPY = 4
#: A block inside an article goes if it stands on this share of the host's pages, three at least, and such blocks are no more than half of the article.
SITE_PAGES, SITE_SHARE, SITE_PART = 3, 0.9, 0.5
#: Words that a page with nothing else must have in wrappers that look like furniture for these to be its text.
FALLBACK_WORDS = 40
#: Share of a block's words inside links from which it is a teaser, where it follows an article in the same ``main``.
LINKED = 0.6

#: HTML element names by their part in a page.
DROPPED = frozenset("script style noscript template svg math head title iframe object canvas audio video select option textarea button".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEAD_CONTENT = frozenset("base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role.  Clear ones mark page furniture in any compound, plain ones beside neutral words alone
# (``share-buttons``, not ``share-price``); outside an article layout words do so too.  After ``has`` and the like none does.
CLEAR = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter disqus breadcrumb breadcrumbs navbar sidebar popup modal "
    "subscribe signup pagination pager masthead comments commentlist contentinfo complementary".split()
)
FURNITURE = frozenset("promo nav navigation menu notice alert login share sharing social related recommended comment respond reply replies".split())
LAYOUT = frozenset("banner widget footer header overlay search toolbar skip legal copyright".split())
NEUTRAL = frozenset(
    "bar box wrap wrapper wrapping container area block section list links link buttons button icons icon form item items inner outer top bottom left right mobile desktop post posts "
    "article articles story stories content contents text title body heading head footer header banner widget widgets unit slot module modules panel row col column group main page site "
    "global primary secondary small large sticky fixed author meta thread count the a to this us ul ol li div".split()
)
NEGATED = frozenset("has no not with without hide hidden show is".split())
# Words that name layouts of whole pages as well: an ``article`` inside is content.
OPEN = frozenset("sidebar search legal widget overlay notice alert".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class words that name parts of an article.
ARTICLE_PART = re.compile(r"^(?:post|entry|article|story|content)[-_]?(?:header|head|title|body|content|text)$", re.I)
HINT_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*$", re.S)
HINTS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW_END = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
#: Zones: neither marked as content nor as furniture, inside an article, furniture, a wrapper that looks like furniture, and beside the articles of a ``main``.
PLAIN, ARTICLE, FURNISHED, WRAPPED, BESIDE = range(5)


def _joined(part: str, words: frozenset) -> str | None:
    """The word of ``words`` that the part is, alone or joined with a neutral one (``commentlist``)."""
    if part in words:
        return part
    return next((part[:k] for k in range(len(part) - 1, 1, -1) if part[:k] in words and part[k:] in NEUTRAL), None)


def furniture_words(hints: str, zone: int) -> set[str]:
    """The words by which class, id and role of a block element mark it as page furniture; plain words inside an article."""
    plain, found = FURNITURE if zone == ARTICLE else FURNITURE | LAYOUT, set()
    for hint in hints.split():
        parts = [x.lower() for x in HINT_PARTS.findall(hint)]
        if ARTICLE_PART.match(hint) or NEGATED & set(parts):
            continue
        found |= {w for x in parts if (w := _joined(x, CLEAR))}
        named = [_joined(x, plain) for x in parts]
        if all(w or x in NEUTRAL or x in CLEAR or len(x) == 1 for w, x in zip(named, parts)):
            found |= {w for w in named if w}
    return found


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block in page order; white space is one space, references are decoded.

    An ``article`` or ``main`` brings content back inside a form or a wrapper
    whose class looks like furniture, but not inside other furniture.  Once a
    ``main`` has had an article, what it holds beside is a zone of its own,
    without the blocks that are links and headings of nothing else.
    """
    out: list[tuple[int, str]] = []
    text: list[str] = []
    linked: list[str] = []  # the part of the text that stands in links
    in_link, heading = False, ""
    stack: list[tuple[str, int]] = []  # element, zone inside it
    zone, at = PLAIN, 0

    def end_block() -> None:
        nonlocal text, linked, heading
        if text and (whole := " ".join(html.unescape("".join(text)).split())):
            if zone != BESIDE:
                out.append((zone, whole))
                heading = ""
            elif any(x in HEADINGS for x, _ in stack[-2:]):
                heading = whole
            elif len("".join(linked).split()) < LINKED * len(whole.split()):
                out.extend((zone, x) for x in (heading, whole) if x)
                heading = ""
        text, linked = [], []

    def leave_head() -> None:
        """Text, ``body`` or any element that a head can't hold ends it, with or without its end tag."""
        nonlocal zone
        end_block()
        stack.pop()
        zone = stack[-1][1] if stack else PLAIN

    while at < len(page):
        m = TOKEN.search(page, at)
        between = page[at : m.start() if m else len(page)]
        if stack and stack[-1][0] == "head" and between.strip():
            leave_head()
        text.append(between)
        if in_link:
            linked.append(between)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in RAW_END and not m[3].endswith("/"):
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            in_link = not closing
        if name in BLOCKS:
            end_block()
        if not closing and stack and stack[-1][0] == "head" and name not in HEAD_CONTENT:
            leave_head()
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None and (name in BLOCKS or not any(x in CHROME or x in MAIN for x, _ in stack[depth + 1 :])):
                if stack[depth][1] != (stack[depth - 1][1] if depth else PLAIN):
                    end_block()
                del stack[depth:]
                zone = stack[-1][1] if stack else PLAIN
        elif name not in VOID and not m[3].endswith("/"):
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
                stack.pop()
            inner = zone
            hints = " ".join(x or y or z for x, y, z in HINTS.findall(m[3])) if "=" in m[3] else ""
            marks = furniture_words(hints, zone) if hints and name in BLOCKS and name not in ("body", "html") else set()
            if name in DROPPED or (name in CHROME and name != "form" and not (name == "header" and zone in (ARTICLE, BESIDE))):
                inner = FURNISHED
            elif zone == FURNISHED:
                pass
            elif marks or name == "form":
                inner = FURNISHED if zone in (ARTICLE, BESIDE) or marks - OPEN else WRAPPED
            elif name in MAIN or re.search(r"(?:^|\s)main(?:\s|$)", hints):
                inner = ARTICLE
            if name == "article" and inner == ARTICLE and any(x == "main" for x, _ in stack):
                stack[:] = [(x, BESIDE if z == ARTICLE and "article" not in (y for y, _ in stack[: k + 1]) else z) for k, (x, z) in enumerate(stack)]
            if inner != zone:
                end_block()
            stack.append((name, inner))
            zone = inner
    end_block()
    return out


_U = np.uint64
_PLACES = np.random.default_rng(20240301).integers(1, 1 << 63, RUN, dtype=np.uint64) * _U(2) + _U(1)
_END = _U(0x9E3779B97F4A7C15)
_words: dict[str, int] = {}


def _word_hashes(words: list[str]) -> list[int]:
    if len(_words) > 400_000:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return [_words[w] for w in words]


def suffixes(blocks: list[tuple[int, str]]) -> tuple[np.ndarray, list[int]]:
    """(keys, starts): the key of each suffix of a page's plain blocks by its first ``RUN`` tokens, and where blocks start.

    The tokens are words, with an end token before, between and after blocks.
    A suffix never reaches beyond its page.
    """
    tokens, starts = [int(_END)], []
    for _, text in blocks:
        starts.append(len(tokens))
        tokens += [*_word_hashes(text.split(" ")), int(_END)]
    own = np.array(tokens, _U)
    keys = np.zeros(max(0, len(own) - RUN + 1), _U)
    for k in range(RUN):
        keys += own[k : k + len(keys)] * _PLACES[k]
    return mixed(keys).view(np.int64), starts


def block_key(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=1)).astype(np.int64))


def page_keys(blocks: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys that may stand on other pages, and whether each is that of an article's block.

    The others are the suffixes of what stands beside the article, or of all text of a page without one.
    """
    marked = np.unique(np.array([block_key(t) for z, t in blocks if z == ARTICLE], np.int64))
    rest = np.unique(suffixes([x for x in blocks if x[0] == BESIDE] if len(marked) else unmarked(blocks))[0])
    return np.concatenate([marked, rest]), np.arange(len(marked) + len(rest)) < len(marked)


def unmarked(blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The blocks that may be the text of a page without an article: plain ones, else those of wrappers that look like furniture, if they say enough."""
    plain = [x for x in blocks if x[0] == PLAIN]
    wrapped = [x for x in blocks if x[0] == WRAPPED]
    return wrapped if not plain and sum(len(t.split(" ")) for _, t in wrapped) >= FALLBACK_WORDS else plain


def covered(blocks: list[tuple[int, str]], repeats: dict[int, int]) -> list[tuple[int, int, str]]:
    """For each block the pages that share it (0: it stays), its words, and what stays of it."""
    keys, starts = suffixes(blocks)
    cover = np.zeros(len(keys) + RUN - 1, np.int64)
    if repeats:
        pages = np.fromiter((repeats.get(k, 0) for k in keys.tolist()), np.int64, len(keys))
        for k in range(RUN):
            cover[k : k + len(pages)] = np.maximum(cover[k : k + len(pages)], pages)
    found = []
    for (_, text), at in zip(blocks, starts):
        words = text.split(" ")
        own = cover[at : at + len(words)]
        unique = [w for w, n in zip(words, own) if not n]
        whole = len(words) - len(unique) >= COVERED * len(words)
        found.append((int(own.max()), len(words), text) if whole else (0, len(unique), " ".join(unique)))
    return found


def main_text(blocks: list[tuple[int, str]], repeats: dict[int, int]) -> str:
    """Main text of a page, given the keys that count as repeated and the number of pages that have each."""
    marked = [t for z, t in blocks if z == ARTICLE]
    if marked:
        size = lambda texts: sum(len(t.split(" ")) for t in texts)
        site = {t for t in marked if block_key(t) in repeats}
        if size(t for t in marked if t in site) > SITE_PART * size(marked):
            site = set()  # a copy of the article on every page
        beside = iter(covered([x for x in blocks if x[0] == BESIDE], repeats))
        stay = []
        for z, t in blocks:
            if z == ARTICLE and t not in site:
                stay.append(t)
            elif z == BESIDE:
                pages, _, rest = next(beside)
                stay.append("" if pages else rest)
        return "\n\n".join(t for t in stay if t)
    found = covered(unmarked(blocks), repeats)  # pages that share the block (0: it stays), words, what stays
    if shared := [n for n, _, _ in found if n]:
        words_of = lambda pages: sum(size for n, size, _ in found if n == pages)
        least = min(shared)
        # A page with next to nothing of its own is a copy: what fewest pages have is its content.
        if not words_of(0) or COPY * words_of(0) <= words_of(least) and 2 * least <= max(shared):
            found = [(0 if n == least else n, size, text) for n, size, text in found]
    return "\n\n".join(text for n, _, text in found if not n)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


PARSED = "_host string, _page long, _id {kind}, _url string, _zones binary, _texts array<string>"


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page as blocks: _host, _page (hash of host and html, the page's identity), _id, _url, _zones (a byte each), _texts."""
    content = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), content.alias("_html"))
    own = own.withColumn("_host", host_of(F.col("_url"))).select("_host", F.xxhash64("_host", "_html").alias("_page"), "_id", "_url", "_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found = [blocks_of(t.as_py()) for t in part.column(4)]
                zones = pa.array([bytes(z for z, _ in x) for x in found], pa.binary())
                texts = pa.array([[t.encode("utf-8", "replace").decode() for _, t in x] for x in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], zones, texts], ["_host", "_page", "_id", "_url", "_zones", "_texts"])

    return own.mapInArrow(run, PARSED.format(kind=pages.schema[id_col].dataType.simpleString()))


def _blocks(zones: pa.Scalar, texts: pa.Scalar) -> list[tuple[int, str]]:
    return list(zip(zones.as_py(), texts.as_py()))


def repeated_keys(parsed: DataFrame) -> DataFrame:
    """(_page, repeats): for pages that have some, the keys that other pages of the host share, each with its number of pages.

    Suffixes count from two distinct pages, blocks of marked articles from
    ``SITE_PAGES`` distinct pages and ``SITE_SHARE`` of the host's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                host, page, zones, texts = batch.slice(i, 256).columns
                found = [page_keys(_blocks(z, t)) for z, t in zip(zones, texts)]
                at = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
                flat, marked = (np.concatenate([x[c] for x in found]) for c in range(2))
                yield pa.RecordBatch.from_arrays([host.take(pa.array(at)), page.take(pa.array(at)), pa.array(flat, pa.int64()), pa.array(marked)], ["_host", "_page", "_key", "_marked"])

    own = parsed.select(F.xxhash64("_host").alias("_host"), "_page", "_zones", "_texts")
    keys = own.mapInArrow(run, "_host long, _page long, _key long, _marked boolean")
    keys = keys.distinct()  # repeated rows of a page are one page
    sizes = own.groupBy("_host").agg(F.count_distinct("_page").alias("_pages"))
    counts = keys.groupBy("_host", "_key", "_marked").agg(F.count("*").alias("n"), F.min("_page").alias("low"), F.max("_page").alias("high")).filter("low <> high")
    counts = counts.join(sizes, "_host").filter(~F.col("_marked") | ((F.col("n") >= SITE_PAGES) & (F.col("n") >= SITE_SHARE * F.col("_pages"))))
    met = keys.join(counts.select("_host", "_key", "_marked", "n"), ["_host", "_key", "_marked"])
    return met.groupBy("_page").agg(F.collect_list(F.struct("_key", "n")).alias("repeats"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars): main text of every page from its whole html.

    Repeats are counted over all pages of a host, however many, by grouping;
    a page is told by its html, so copies of one page count once.  Defined
    cases: a null or empty html, or one without main text, gives ''; a null
    url is the host ''; repeated rows are all returned, alike; a page
    with next to nothing that other pages don't repeat is a copy and keeps the
    blocks that the fewest pages have; a very long page is parsed whole; an empty table gives
    an empty table; other columns are not looked at.
    """
    parsed = settle(parsed_pages(pages, id_col, url_col, html_col), "pages")
    # Settled, so that its size is known: where few pages have repeats, the texts need no shuffle.
    repeats = settle(repeated_keys(parsed).withColumnRenamed("_page", "_own"), "repeats")
    joined = parsed.join(repeats, F.col("_page") == F.col("_own"), "left").select("_id", "_url", "_zones", "_texts", "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                ids, urls, zones, texts, repeats = batch.slice(i, 256).columns
                found = [main_text(_blocks(z, t), {x["_key"]: x["n"] for x in r.as_py() or ()}) for z, t, r in zip(zones, texts, repeats)]
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
