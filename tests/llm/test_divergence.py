import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, value long, rank int"


def plain(rows, top=200):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= 3]
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        total = sum(own.values(), Counter())
        def probabilities(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        p = {s: probabilities(c) for s, c in own.items()}
        q = probabilities(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def made(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    df = divergence.divergence(docs, **more)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def corpus(rng, n, sources, langs=("en", "de", None), words=60):
    vocabulary = ["Über", "ÉTÉ", "don't", "x1y", "日本", *(f"{chr(97 + k % 26)}{chr(97 + k // 26)}Word" for k in range(words))]
    rows = []
    for k in range(n):
        text = " ".join(vocabulary[min(int(rng.expovariate(6 / len(vocabulary))), len(vocabulary) - 1)] for _ in range(rng.randrange(30)))
        rows.append((k, rng.choice([text, text, text, None, ""]), rng.choice(langs), rng.choice(sources), 7, 1))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_counts(spark, seed):
    rng = random.Random(seed)
    rows = corpus(rng, 150, ["a", "b", "ü", None, "z z"]) + [(900, None, "fr", "a", 0, 0), (901, "only here", "fr", "b", 0, 0), (902, "1 2 3", "", "", 0, 0), (902, "1 2 3", "", "", 0, 0)]
    assert made(spark, rows) == plain(rows)


def test_many_sources_in_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "CHUNK", 64)
    monkeypatch.setattr(divergence, "GATHERED", 50)
    monkeypatch.setattr(divergence, "ROWS_AT_ONCE", 2)
    rng = random.Random(7)
    rows = corpus(rng, 260, [f"s{k}" for k in range(8)], ("en", "de"), words=300)
    assert made(spark, rows, top=5) == plain(rows, 5)


def test_empty_tables(spark):
    assert made(spark, []) == []
    assert made(spark, [(1, None, None, None, 0, 0)]) == []
    assert made(spark, [(1, None, "en", "a", 0, 0), (2, "x", "en", "b", 0, 0)]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_chunk_sums_against_single_terms():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 4, size=(5, 130))
    p = 1 + 10**6 * (counts + 1) // (counts.sum(axis=1)[:, None] + 130)
    lacking = 1 + 10**6 // (counts.sum(axis=1) + 130)
    levels = []
    for s in range(5):
        for word in range(3):
            for v in sorted(set(counts[s, word * 64 : word * 64 + 64].tolist()) - {0}):
                bits = sum(1 << k for k, c in enumerate(counts[s, word * 64 : word * 64 + 64].tolist()) if c == v)
                levels.append((word, s, int(p[s][counts[s] == v][0]), bits))
    levels.sort(key=lambda x: x[0])
    w, s, q, bits = zip(*levels)
    side = np.array(s), np.array(q), np.array(w), np.array(bits, dtype=np.uint64)
    want = [[int(((a - b) ** 2 // b).sum()) for b in p] for a in p]
    assert divergence._chunk_sums(lacking, lacking, 130, side, side).tolist() == want
