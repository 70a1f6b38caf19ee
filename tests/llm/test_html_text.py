import html
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import html_text as h


def article(page):
    """The article of a page of the test tables, whose markup is known."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:p|h1)>", inner)]
    return " ".join(" ".join(p.split()) for p in parts if p.split())


def texts(page):
    found = h.blocks(page)
    return [t for z, t in found if z == "article"]


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(var i=0;i<n;i++){t(i);}</script>",
        "<SCRIPT>if (a<b) x = 'it';</Script >",
        """<script>s = "don't <b"; // it's</script>""",
        """<script>s = '</scripts>' + "<a href='";</script>""",
        "<style>a::before{content:'<b'}</style>",
        "<title>a<b and c's</title>",
        "<script><!-- i<n </script>",
    ],
)
def test_raw_text_ends_at_its_end_tag(raw):
    assert h.blocks(f"{raw}<article><p>Story</p></article>") == [("article", "Story")]
    assert h.blocks(f"<p>Before</p>{raw[: raw.rindex('</')]}") == [("open", "Before")]


def test_blocks():
    page = """<html><head><title>No</title></head><body><header>Top</header><nav><ul><li>Home</ul></nav>
    <div class="cookie-notice"><div>We use</div> cookies</div><article class=post><header><h1>The  title</h1></header>
    <p>One <b>bo</b>ld &amp; more<br>line<p>Two&nbsp;x<aside>side</aside><form>Name <input></form><script>var a="</p>";</script>
    <div id="comments"><article class="comment">nice</article></div><!-- <p>no</p> --><td>3 < 4</td></article>
    <footer>&copy; me</footer></body>"""
    assert texts(page) == ["The title", "One bold & more line", "Two x", "3 < 4"]
    assert h.blocks("") == [] and h.blocks("plain &lt;text") == [("open", "plain <text")]
    assert texts("<article>cut o<b") == ["cut o"]


def brute(streams, long, least):
    out = []
    grams = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - long + 1):
            grams.setdefault(tuple(s[i : i + long]), set()).add(k)
    for s in streams:
        hit = [False] * len(s)
        for i in range(len(s) - long + 1):
            if len(grams[tuple(s[i : i + long])]) >= least:
                hit[i : i + long] = [True] * long
        out.append(hit)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=6), st.integers(1, 4))
def test_substrings_match_brute_force(streams, long):
    tokens = [np.array([ord(x) for x in s], dtype=np.uint32) for s in streams]
    zones = [np.full(len(s), h.OPEN, dtype=np.int8) for s in streams]
    hashes, in_article, n, holders = h.substrings(tokens, zones, True, long) if any(streams) else ([], [], [], [])
    assert not any(in_article)
    grams = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - long + 1):
            grams.setdefault(h.windows(tokens[k][i : i + long].astype(np.uint64), long).view(np.int64)[0], set()).add(k)
    assert {x: (c, set(on.tolist())) for x, c, on in zip(hashes, n, holders)} == {x: (len(on), on) for x, on in grams.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=6), st.integers(1, 4), st.integers(1, 3))
def test_unique_text_matches_brute_force(streams, long, least):
    pages = [f"<div>{' '.join(s)}</div>" for s in streams]
    hits = brute(streams, long, least)
    common = set()
    for s in streams:
        for i in range(len(s) - long + 1):
            gram = s[i : i + long]
            if sum(any(t[j : j + long] == gram for j in range(len(t) - long + 1)) for t in streams) >= least:
                common.add(h.windows(h.stream([" ".join(gram)], [h.OPEN])[0].astype(np.uint64), long).view(np.int64)[0])
    for page, s, hit in zip(pages, streams, hits):
        assert h.unique_text(page, None, list(common), long) == " ".join(w for w, x in zip(s, hit) if not x)


def test_suffix_array():
    rng = random.Random(1)
    t = np.array([rng.randrange(3) for _ in range(200)])
    order, shared = h.suffix_array(t)
    suffixes = [t[i:].tolist() for i in range(len(t))]
    assert order.tolist() == sorted(range(len(t)), key=lambda i: suffixes[i])
    for (a, b), n in zip(zip(order, order[1:]), shared[1:]):
        want = next((k for k, (x, y) in enumerate(zip(suffixes[a], suffixes[b])) if x != y), min(len(suffixes[a]), len(suffixes[b])))
        assert n == want


@pytest.mark.parametrize(
    "name, inside, outside",
    [("ad", 1, 1), ("ad-slot-2", 1, 1), ("promo-code", 0, 0), ("social-science", 0, 0), ("commentList", 1, 1), ("cookie-notice", 1, 1), ("page-header", 0, 1), ("story", 0, 0), ("share-buttons", 1, 1), ("", 0, 0)],
)
def test_names_furniture(name, inside, outside):
    name = h.CAMEL.sub("-", name).lower()
    assert h.names_furniture(name, True) == bool(inside) and h.names_furniture(name, False) == bool(outside)


@pytest.mark.parametrize("junk", ["<a \"", "<a '", "<a b=\"", "<a b='x' c=\"", "<", "<!--", "<a =", "</", "<div x ", "<x a=b=", "<script>", "&amp"])
def test_hostile_pages_are_read_in_linear_time(junk):
    page = "<p>start</p>" + junk * ((1 << 20) // len(junk)) + "'"
    began = time.process_time()
    assert h.blocks(page)[0] == ("open", "start")
    assert time.process_time() - began < 4


def test_unclosed_quote_is_no_value():
    assert h.blocks('<p title="abc>text</p>') == [("open", "text")]
    assert h.blocks("<p title='a>b'>text</p><p>x</p>") == [("open", "text"), ("open", "x")]
    assert h.blocks('<p "a>text</p><script src=x />no</script>') == [("open", "text")]


def menu_pages(n, host="a.example", more=""):
    menu = "<div>Home</div><div>All about this great site</div><div>Contact and imprint of us</div>"
    return [(k, f"https://{host}/{k}", f"<body>{menu}<div>Story number {k} tells of {'x' * (k + 1)} and then ends here for good {more}</div></body>") for k in range(n)]


def story(k):
    return f"Story number {k} tells of {'x' * (k + 1)} and then ends here for good"


def test_pages_without_article(spark):
    rows = menu_pages(12)
    rows += [(100, None, None), (None, "https://b.example/", "<p>alone</p>"), (101, "https://c.example", "")]
    df = spark.createDataFrame([(*r, "host") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in h.main_text(df).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert got[k] == story(k)
    assert got[None] == "alone" and got[100] == got[101] == ""
    assert h.main_text(df.limit(0)).collect() == []


def test_without_the_array_the_menu_stays(spark, monkeypatch):
    df = spark.createDataFrame(menu_pages(12), "page_id long, url string, html string")
    with_array = {r.page_id: r.text for r in h.main_text(df).collect()}
    monkeypatch.setattr(h, "MIN_PAGES", 10**9)
    without = {r.page_id: r.text for r in h.main_text(df).collect()}
    assert all(without[k] == "Home All about this great site Contact and imprint of us " + with_array[k] for k in range(12))


def test_repeated_rows_count_once(spark):
    rows = menu_pages(1) * 5 + [(50, "https://b.example/1", "<p>One page whose text is here five times over and over</p>")] * 5
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == sorted(["Home All about this great site Contact and imprint of us " + story(0)] * 5 + ["One page whose text is here five times over and over"] * 5)


def test_passage_on_few_pages_of_a_large_host_in_many_parts(spark):
    passage = "this passage stands on only three pages of the whole large host"
    rows = [(k, u, p.replace("</body>", f"<p>{passage}</p></body>") if k in (5, 200, 555) else p) for k, u, p in menu_pages(600)]
    rows[7] = (7, rows[7][1], rows[7][2].replace("</body>", "<p>while this stands on two pages of the host and stays</p></body>"))
    rows[9] = (9, rows[9][1], rows[9][2].replace("</body>", "<p>while this stands on two pages of the host and stays</p></body>"))
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), part_bytes=4000).collect()}
    for k in range(600):
        assert got[k] == story(k) + (" while this stands on two pages of the host and stays" if k in (7, 9) else "")


def test_articles_keep_what_they_share_unless_the_whole_site_has_it(spark):
    notice, shared = "sign up now for the letter that we send each week", "a passage of nine words that three articles share"
    rows = [(k, f"https://s.example/{k}", f"<article><p>{story(k)}</p><p>{notice}</p>{f'<p>{shared}</p>' if k < 3 else ''}</article>") for k in range(80)]
    rows += [(100 + k, f"https://t.example/{k}", f"<article><p>{story(k)}</p><p>{notice}</p></article>") for k in range(20)]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(80):
        assert got[k] == story(k) + (f" {shared}" if k < 3 else "")
    for k in range(20):
        assert got[100 + k] == f"{story(k)} {notice}"


@pytest.mark.parametrize("pages, holders, cut", [(80, 48, True), (80, 47, False), (32, 30, True), (32, 29, False), (29, 29, False)])
def test_share_of_a_site_dealt_to_small_parts(spark, pages, holders, cut):
    notice = "sign up now for the letter that we send each week"
    rows = [(k, f"https://s.example/{k}", f"<article><p>{story(k)}</p>{f'<p>{notice}</p>' if k < holders else ''}</article>") for k in range(pages)]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows * 2, "page_id long, url string, html string"), part_bytes=500).collect()}
    for k in range(pages):
        assert got[k] == story(k) + (f" {notice}" if k < holders and not cut else "")


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in h.main_text(pages).collect()}
    assert got == {r.page_id: article(r.html) for r in pages.collect()}
