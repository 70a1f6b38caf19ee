import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import near_dup as nd
from lectern.llm.common import word_hashes


def brute(rows, at_least, size=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= at_least * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    """Chains of near copies, groups of copies, texts that share passages, and short ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    texts, passage = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(1, 7)):
            base = list(base)
            for _ in range(rng.randrange(0, 3)):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
    texts += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(30)]) for _ in range(10)]
    texts += ["one two", "ONE  two", "a b c d e", "a b c d e f", "a b c d e f g h i j k", "a b c d e f g h i j k l", "", None, " \n", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,at_least", [(1, 80), (2, 85)])
def test_matches_brute_force(spark, seed, at_least):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs, at_least).collect()}
    assert got == brute(rows, at_least)


def test_wrong_centres_hide_no_links(spark, monkeypatch):
    """With one-row bands most buckets hold strangers, so links must be found in later rounds."""
    monkeypatch.setattr(nd, "ROWS", 1)
    monkeypatch.setattr(nd, "bands_for", lambda a, b: 6)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 80).collect()}
    want = {i: c for i, (_, c, _) in brute(rows, 80).items()}
    assert got == want


def test_repeats_nulls_and_no_rows(spark):
    t = "some words that make a text of more than five words"
    docs = spark.createDataFrame([(5, t), (5, t), (3, t), (None, t), (None, None), (5, "other words that make a different text altogether")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs).collect())
    assert got == sorted([("5", 7, 3, False), ("5", 7, 3, False), ("3", 7, 3, True), ("None", 7, 3, False), ("None", 0, None, True), ("5", 4, 5, True)])
    assert nd.near_duplicates(docs.limit(0)).collect() == []


def test_word_hashes():
    texts = [b"a bc  longerthaneight", b"", b" A\tBC\n", b"longerthaneigh longerthaneight " + "é".encode() * 3000]
    h, counts = word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    seen = {}
    for w, x in zip([w.lower() for t in texts for w in t.split()], h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, same in ((400, 340), (20, 17), (7, 6)):
        hits = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, size=2 * n - same, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - same :])
            sa, sb = nd.signatures([a, b], 160)
            hits.append((sa == sb).mean())
        assert abs(np.mean(hits) - same / (2 * n - same)) < 0.06


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (102, 103)] + [(200, x) for x in range(201, 260)]
    df = spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in edges], "a binary, b binary")
    got = {int(bytes(r.node)): int(bytes(r.label)) for r in nd.components(df).collect()}
    assert got == {x: 0 if x < 100 else 100 if x < 200 else 200 for e in edges for x in e}


def overlapping(count=80):
    """Windows of one sequence, each with a copy longer by a word: links hide among overlaps just below 0.85, and linked sets share one rare shingle."""
    words = [f"w{k % count}" for k in range(count + 10)]
    texts = [" ".join(words[k : k + 10]) for k in range(count)]
    texts += [f"{t} x{k}" for k, t in enumerate(texts)]
    random.Random(7).shuffle(texts)
    return list(enumerate(texts))


def test_large_buckets_lose_no_links(spark, monkeypatch):
    sketches = nd._sketches
    one = F.when(F.col("bands").isNotNull(), F.array(F.lit(0).cast("long")))
    monkeypatch.setattr(nd, "_sketches", lambda *a: sketches(*a).withColumn("bands", one))  # all meet in one bucket
    monkeypatch.setattr(nd, "LARGE", 4)
    # what an earlier version had for the search of large buckets
    monkeypatch.setattr(nd, "WHOLE", 0, raising=False)
    monkeypatch.setattr(nd, "CENTRES", 1, raising=False)
    rows = overlapping()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 85).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows, 85).items()}


def test_block_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, size=rng.integers(20, 60))).astype(np.int64) for _ in range(30)]
    common = nd._common(sets[:12], sets[12:])
    assert common.tolist() == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]
    links = nd.block_links(sets, sets, 50, 100)
    edges = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 50 * len(np.union1d(a, b))]
    assert set(links) <= set(edges) and len(links) < len(edges)


def test_null_id_as_centre(spark):
    """A class that only a null id has is linked like any other, and hides no links when it is a centre."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[:k] + ["new"] + words[k + 1 :]) for k in (0, 200, 399)]
    texts.sort(key=lambda t: nd.class_digest(nd.shingle_sets([t.encode()])[0]))
    docs = spark.createDataFrame([(None, texts[0]), (7, texts[1]), (9, texts[2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 85).collect()} == {None: 7, 7: 7, 9: 7}
