import random

import pytest

from lectern.llm import quality as q

PROSE = "This is a sentence of plain words, and it ends well. "


@pytest.mark.parametrize(
    "line,fails",
    [
        ("A plain sentence, that ends with a stop.", False), ("Short title", False), ("Home | About | News | Contact us", True), ("word " * 40, True), ("word " * 40 + "end.", False),
        ("All rights reserved by us and them", True), ("THIS!! IS!! VERY!! LOUD!!", True), ("a### b*** c$$$ d&&& e%%%", True), ("x # y plain words here and more words.", False), ("!!", False), ("Click here to read more now.", True),
        ("Home About News Contact", True), ("Home About us Contact", True), ("The Long Way Home", False), ("Contact the press about events.", False), ("word " * 14, False), ("word " * 15, True),
    ],
)
def test_line_rules(line, fails):
    assert q.line_fails(line.encode()) is fails


def test_menus_of_short_lines():
    menu = ["Latest Stories", "World", "", "Our Sports", "Weather", "Travel", "Food"]
    lines = [x.encode() for x in ["A plain sentence, that ends with a stop.", *menu, "Another one ends here."]]
    assert q.failing(lines) == [False, True, True, False, True, True, True, True, False]
    assert not any(q.failing(lines[:6]))
    assert q.clean(b"\n".join(lines))[1:] == (20, 8)


def brute(text):
    w = (text or "").split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again)


def test_measures_and_verdict(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abcdé<$") for _ in range(rng.randrange(120))).replace(" d ", "\n") for _ in range(60)]
    texts += [None, "", " \n\t", PROSE * 30, "\n".join(f"{PROSE} {k}." for k in range(9)), "x" * 60_000, "\n".join("".join(f"unique{k * 50 + j} word{j * 97 + k}. " for j in range(20)) for k in range(5))]
    docs = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in q.quality(docs).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert got[len(texts) - 1].kept and not got[63].kept
    assert q.quality(docs.limit(0)).collect() == []


def test_labels(spark):
    """Clean documents that pass the base rules stay, junk goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = q.quality(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.99 * len(good) and sum(bad) < 0.05 * len(bad)
