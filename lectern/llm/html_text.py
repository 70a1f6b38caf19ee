"""Main text of web pages by a host's suffix array, with markup as the bound of what repetition can tell.

A page is split into blocks. Elements that are menus, headers, footers, sidebars,
notices, adverts, forms or comments by tag, role or class name never count as text.
The other blocks are candidates: those of the article if the page marks one
(``article``, else ``main``), otherwise all.

Then the host decides. The token streams of its distinct pages are concatenated and
put in suffix order, which brings long substrings together that stand on several pages.
What is covered by a substring on ``MIN_PAGES`` distinct pages is boilerplate; unique
runs stay. Inside a marked article that would take quotations and passages that
articles share, so there a substring must stand on ``SITE_HOLDERS`` distinct pages at
least, and on the share ``SITE_SHARE`` of the host's. A covered run goes out of a block if it is the
whole block or long inside it.

A host's distinct pages are dealt by a hash of their content to parts of about
``PART_BYTES`` bytes, each with its own array. Of each substring, the parts tell on how
many of their pages it stands, and the sums over the host decide. Inside articles a part
only tells what stands on half of the asked share of its pages; what may reach the share
of the host's pages while some part did not tell of it is looked for in all of them. So
the deal changes no result. Copies of one page are one page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, scope, stream_arrow, windows, word_hashes, written

#: Tokens of a substring that counts as long.
LONG = 8
#: Distinct pages of a host that must hold it.
MIN_PAGES = 3
#: Inside marked articles: the distinct pages, and the share of a host's, that must hold it.
SITE_HOLDERS, SITE_SHARE = 30, 0.6
#: Bytes of the pages whose suffixes meet in one array, on average.
PART_BYTES = 1 << 20

#: Where a token stands: in what is never text, in open text, in a marked article.
OUTSIDE, OPEN, ARTICLE = 0, 1, 2

#: Text up to the next tag, comment or declaration.
TEXT = re.compile(r"(?:[^<]++|<(?![a-zA-Z/!?]))++")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<(?:/(?![a-zA-Z])|[!?])[^>]*+(?:>|\Z)", re.S)
#: The part of a tag up to its end or to a quoted value.
PLAIN = re.compile(r"""[^>=]*+(?:=\s*+(?!["'])[^>=]*+)*+(?:=\s*+)?""")
ATTRIBUTE = re.compile(r"""(?<=[\s/"'])([^\s=/>"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "noembed", "xmp"}
#: What ends such an element, whatever its text looks like.
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that open implies closed.
LOOSE = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}
CHROME_TAGS = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "fieldset", "map"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "comment", "comments", "reply", "replies",
    "disqus", "respond", "share", "sharing", "social", "related", "newsletter", "subscribe", "popup", "modal", "widget", "pagination", "pager", "toolbar", "login", "signup",
    "adsbygoogle", "commentlist", "cookiebar", "cookiebanner", "navmenu", "menubar", "topbar", "topnav", "sidenav", "sitenav", "siteheader", "sitefooter",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WORD_BREAK = re.compile(r"[^a-z0-9]+")
#: Words after which the word before is what names an element.
NEUTRAL = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "form", "group", "holder", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "outer",
    "panel", "region", "right", "section", "slot", "thread", "top", "unit", "wrap", "wrapper", "zone",
}
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def is_chrome(tag: str, token: str, in_article: bool) -> bool:
    """Whether an element is page furniture by its tag, role or class names."""
    if tag in CHROME_TAGS:
        return not (tag == "header" and in_article)
    if tag in ("html", "body") or "=" not in token:
        return False
    attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(token)}
    if attributes.get("role", "").lower() in CHROME_ROLES:
        return True
    if tag in HEADINGS or tag in ("main", "a", "span", "b", "i", "em", "strong"):
        return False
    names = CAMEL.sub("-", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower().split()
    return any(names_furniture(x, tag == "article" or in_article) for x in names)


def names_furniture(name: str, in_article: bool) -> bool:
    """Whether a class name says furniture: by its first word, or by the last that tells anything; articles have headers of their own."""
    words = [w for w in WORD_BREAK.split(name) if w and not w.isdigit()]
    while len(words) > 1 and words[-1] in NEUTRAL:
        words.pop()
    if not words or in_article and "header" in words:
        return False
    return words[-1] in CHROME_WORDS or words[0] in CHROME_WORDS and words[0] not in ("promo", "related", "reply", "notice", "social", "share", "sharing")


def tag_end(page: str, at: int, unclosed: dict[str, int]) -> int:
    """Where the tag at ``at`` ends; a value whose quote is never closed is no quoted value.

    ``unclosed`` keeps the place from which on a quote does not occur, so that a page
    is read once whatever its quotes.
    """
    while True:
        at = PLAIN.match(page, at).end()
        if at >= len(page) or page[at] == ">":
            return min(at + 1, len(page))
        quote = page[at]
        close = page.find(quote, at + 1) if at < unclosed.get(quote, len(page)) else -1
        if close < 0:
            unclosed[quote] = min(at, unclosed.get(quote, at))
        at = close + 1 if close >= 0 else at + 1


def blocks(page: str) -> list[tuple[str, str]]:
    """``(zone, text)`` of each block that has text; zones are article, main, open and chrome."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    chrome, depth = "", 0  # the furniture element we are in, and how many of its name are open
    articles = mains = 0

    def close() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(("chrome" if chrome else "article" if articles else "main" if mains else "open", text))

    at, unclosed = 0, {}
    while at < len(page):
        m = TEXT.match(page, at)
        if m:
            parts.append(m[0])
            at = m.end()
            continue
        m = COMMENT.match(page, at)
        if m:
            at = m.end()
            continue
        start, at = at, tag_end(page, at, unclosed)
        token = page[start:at]
        tag = NAME.match(token)[1].lower()
        ends = token[1] == "/"
        if tag in RAW:
            if not ends:
                end = RAW_ENDS[tag].search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag in INLINE and not (chrome and tag == chrome):
            continue
        if tag == "br":
            parts.append(" ")
            continue
        close()
        if ends:
            if chrome:
                if tag == chrome:
                    depth -= 1
                    chrome = chrome if depth else ""
            elif tag == "article":
                articles = max(0, articles - 1)
            elif tag == "main":
                mains = max(0, mains - 1)
            continue
        if tag in VOID or token.endswith("/>"):
            continue
        if chrome in LOOSE and (tag == chrome or chrome == "p"):
            chrome, depth = "", 0
        if chrome:
            depth += tag == chrome
        elif is_chrome(tag, token, bool(articles)):
            chrome, depth = tag, 1
        elif tag == "article":
            articles += 1
        elif tag == "main":
            mains += 1
    close()
    return out


def zoned(page: str) -> tuple[list[str], list[int]]:
    """The blocks of a page, and the zone of each."""
    found = blocks(page)
    best = next((z for z in ("article", "main") if any(x == z for x, _ in found)), "open")
    own = OPEN if best == "open" else ARTICLE
    return [t for _, t in found], [own if z == best else OUTSIDE for z, _ in found]


def stream(texts: list[str], zones: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a page's blocks as 32-bit hashes, the zone of each, and each block's number of tokens."""
    h, counts = word_hashes([t.encode("utf-8", "replace") for t in texts], lower=False) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.repeat(np.array(zones, dtype=np.int8), counts), counts


def whole_windows(part: np.ndarray, long: int) -> np.ndarray:
    """The places at which ``long`` tokens begin that all lie in one part."""
    n = len(part) - long + 1
    return np.flatnonzero(part[:n] == part[long - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and how many tokens each shares with the one before; by prefix doubling.

    With ``depth``, order and shared tokens are exact up to so many tokens.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1]
    levels, k = [rank], 1
    while rank.max(initial=0) < n - 1 and k < min(n, depth or n):
        second = np.concatenate((rank[k:] + 1, np.zeros(min(k, n), dtype=rank.dtype)))[:n]
        rank = np.unique(rank.astype(np.int64) * (n + 1) + second, return_inverse=True)[1]
        levels.append(rank)
        k *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(0, n - 1), dtype=np.int64)
    for level in reversed(range(len(levels))):
        at_a, at_b = a + shared, b + shared
        inside = (at_a < n) & (at_b < n)
        equal = inside & (levels[level][np.minimum(at_a, n - 1)] == levels[level][np.minimum(at_b, n - 1)])
        shared += equal.astype(np.int64) << level
    return order, np.concatenate(([0], shared))


def substrings(tokens: list[np.ndarray], zones: list[np.ndarray], is_site: bool, long: int = LONG) -> tuple:
    """The long substrings of some pages of a host, from the suffix array of their streams.

    ``(hashes, in_article, n_pages, holders)``: each substring of ``long`` tokens, whether inside
    articles, on how many of the pages, and on which it could be text. Outside articles, all
    are told; inside, if the host has as many pages as must hold one, those on half the share.
    """
    flat, zone = np.concatenate(tokens), np.concatenate(zones)
    page = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    starts = whole_windows(page * 3 + zone, long)
    order, shared = suffix_array(flat, long)
    group = np.empty(len(flat), dtype=np.int64)
    group[order] = np.cumsum(shared < long)
    inside = zone[starts] == ARTICLE
    if not is_site:
        starts, inside = starts[~inside], inside[~inside]
    at = np.lexsort((page[starts], group[starts] * 2 + inside))
    starts = starts[at]
    key, on = group[starts] * 2 + inside[at], page[starts]
    new_key = np.diff(key, prepend=-1) != 0
    new = new_key | (np.diff(on, prepend=-1) != 0)
    n_pages = np.bincount(np.cumsum(new_key)[new] - 1) if len(key) else np.zeros(0, dtype=np.int64)
    first = starts[new_key]
    in_article = zone[first] == ARTICLE
    told = ~in_article | (n_pages >= SITE_SHARE / 2 * len(tokens))
    holder = zone[starts] != OUTSIDE
    of = np.cumsum(new_key) - 1
    pairs = np.unique(np.stack((of[holder], on[holder])), axis=1)
    pairs = pairs[:, told[pairs[0]]]
    kept = np.flatnonzero(told)
    cuts = np.searchsorted(pairs[0], kept[1:])
    holders = np.split(pairs[1], cuts) if len(kept) else []
    hashes = windows(flat.astype(np.uint64), long)[first[told]].view(np.int64) if len(kept) else np.zeros(0, dtype=np.int64)
    return hashes, in_article[told], n_pages[told], holders


def unique_text(page: str, in_article: list[int] | None, outside: list[int] | None, long: int = LONG) -> str:
    """The page's text without the runs that the given substrings cover."""
    texts, zones = zoned(page)
    if not in_article and not outside:
        return " ".join(t for t, z in zip(texts, zones) if z != OUTSIDE)
    flat, zone, counts = stream(texts, zones)
    starts = whole_windows(zone, long)
    hashes = windows(flat.astype(np.uint64), long)[starts].view(np.int64)
    inside = zone[starts] == ARTICLE
    hit = np.where(inside, np.isin(hashes, np.array(in_article or [], dtype=np.int64)), np.isin(hashes, np.array(outside or [], dtype=np.int64)))
    mask = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(mask, starts[hit], 1)
    np.add.at(mask, starts[hit] + long, -1)
    covered = np.cumsum(mask[:-1]) > 0
    out = []
    for text, z, end, n in zip(texts, zones, np.cumsum(counts).tolist(), counts.tolist()):
        own = covered[end - n : end]
        if z == OUTSIDE or own.all():
            continue
        # a run that only reaches into a block from another takes nothing of it
        edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).reshape(-1, 2)
        for lo, hi in edges.tolist():
            own[lo:hi] = hi - lo >= long
        out.append(" ".join(w for w, gone in zip(text.split(), own) if not gone) if own.any() else text)
    return " ".join(out)


def _streams(rows: DataFrame) -> DataFrame:
    """``(host, page, tokens, zones)`` of each distinct content, once for each input partition at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        seen: set[tuple[int, bytes]] = set()
        for b in batches:
            out: list[list] = [[], [], [], []]
            for host, page, text in zip(*(c.to_pylist() for c in b.columns)):
                if (host, page) in seen:
                    continue
                seen.add((host, page))
                flat, zone, _ = stream(*zoned(text))
                for to, x in zip(out, (host, page, flat.view(np.int32), zone)):
                    to.append(x)
            yield out

    return stream_arrow(rows.select("host", "page", "html"), each, "host bigint, page binary, tokens array<int>, zones array<tinyint>")


def _substrings(dealt: DataFrame) -> DataFrame:
    """``(host, hash, in_article, n, of, pages)`` of each part's substrings; ``of`` is its number of pages."""

    def told(part: tuple, pages: list[bytes], tokens: list[np.ndarray], zones: list[np.ndarray]) -> list:
        if not sum(map(len, tokens)):
            return [[], [], [], [], [], []]
        hashes, in_article, n, holders = substrings(tokens, zones, part[2])
        return [[part[0]] * len(hashes), hashes, in_article, n, [len(pages)] * len(hashes), [[pages[k] for k in x] for x in holders]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        part, pages, tokens, zones = None, [], [], []
        for b in batches:
            for own, page, own_tokens, own_zones in zip(zip(*(b.column(k).to_pylist() for k in range(3))), b.column(3).to_pylist(), b.column(4), b.column(5)):
                if own != part:
                    if part is not None:
                        yield told(part, pages, tokens, zones)
                    part, pages, tokens, zones = own, [], [], []
                if not pages or page != pages[-1]:
                    pages.append(page)
                    tokens.append(own_tokens.values.to_numpy().view(np.uint32))
                    zones.append(own_zones.values.to_numpy())
        if part is not None:
            yield told(part, pages, tokens, zones)

    return stream_arrow(dealt.select("host", "part", "is_site", "page", "tokens", "zones"), each, "host bigint, hash bigint, in_article boolean, n bigint, of bigint, pages array<binary>")


def _holding(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(host, hash, page)``: the distinct pages whose articles hold the wanted substrings ``(host, hash)``.

    A host has few of them: each stands on three tenths of its pages, which so many windows
    of a mean page can do three times over.
    """

    def columns(b: pa.RecordBatch) -> list:
        out: list[list] = [[], [], []]
        for host, page, text, hashes in zip(*(c.to_pylist() for c in b.columns)):
            flat, zone, _ = stream(*zoned(text))
            starts = whole_windows(zone, LONG)
            own = windows(flat.astype(np.uint64), LONG)[starts[zone[starts] == ARTICLE]].view(np.int64)
            for h in np.intersect1d(own, np.array(hashes, dtype=np.int64)).tolist():
                for to, x in zip(out, (host, h, page)):
                    to.append(x)
        return out

    asked = wanted.groupBy("host").agg(F.collect_list("hash").alias("hashes"))
    joined = rows.join(asked, "host").select("host", "page", "html", "hashes")
    return map_arrow(joined, columns, "host bigint, hash bigint, page binary").distinct()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part_bytes: int = PART_BYTES) -> DataFrame:
    """``(id, url, text)`` for each row of ``pages``: the main text.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined in page order by one space. Null and empty pages have an empty
    text; repeated rows each get a row and count as one page; null ids and urls stay
    null, and pages without a host form one host; other columns are ignored, whatever
    their names.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(host).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.unhex(F.md5("html")))

    with scope(pages.sparkSession) as kept:
        hosts = rows.groupBy("host").agg(F.countDistinct("page").alias("n_pages"), F.sum(F.octet_length("html")).alias("n_bytes"))
        parts = F.ceil(F.col("n_bytes") / part_bytes).alias("parts")
        hosts = written(hosts.select("host", "n_pages", (F.col("n_pages") >= SITE_HOLDERS).alias("is_site"), parts), "hosts")
        dealt = _streams(rows).join(hosts.where("parts > 0").drop("n_pages"), "host").withColumn("part", F.pmod(F.xxhash64("page"), "parts"))
        dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "page")
        found = written(_substrings(dealt), "substrings")
        sums = found.groupBy("host", "hash", "in_article").agg(F.sum("n").alias("n"), F.sum("of").alias("of")).join(hosts.select("host", "n_pages"), "host")
        share, silent = F.greatest(SITE_SHARE * F.col("n_pages"), F.lit(float(SITE_HOLDERS))), F.col("n_pages") - F.col("of")
        # each silent part holds it on fewer than half the share of its pages
        unsure = F.col("in_article") & (silent > 0) & (F.col("n") + SITE_SHARE / 2 * silent >= share)
        sums = sums.where(unsure | F.when(F.col("in_article"), F.col("n") >= share).otherwise(F.col("n") >= MIN_PAGES))
        sums = written(sums.select("host", "hash", "in_article", unsure.alias("unsure")), "common")
        common = sums.where("not unsure").drop("unsure")
        marked = found.join(common, ["host", "hash", "in_article"]).select("host", F.explode("pages").alias("page"), "hash", "in_article")
        if sums.where("unsure").limit(1).count():
            holding = written(_holding(rows, sums.where("unsure")), "holding")
            counted = holding.groupBy("host", "hash").agg(F.count("*").alias("n")).join(hosts.select("host", "n_pages"), "host").where(F.col("n") >= share)
            also = holding.join(written(counted.select("host", "hash"), "counted"), ["host", "hash"])
            marked = marked.unionByName(also.select("host", "page", "hash", F.lit(True).alias("in_article")))
        in_article = F.collect_set(F.when(F.col("in_article"), F.col("hash"))).alias("in_article")
        marks = marked.groupBy("host", "page").agg(in_article, F.collect_set(F.when(~F.col("in_article"), F.col("hash"))).alias("outside"))
        marks = kept(written(marks, "marks"))

    def columns(b: pa.RecordBatch) -> list:
        texts, inner, outer = (b.column(k).to_pylist() for k in (2, 3, 4))
        return [b.column(0), b.column(1), [unique_text(*x) for x in zip(texts, inner, outer)]]

    kind = pages.schema[id_col].dataType.simpleString()
    joined = rows.join(marks, ["host", "page"], "left").select("id", "url", "html", "in_article", "outside")
    return map_arrow(joined, columns, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
