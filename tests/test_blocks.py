"""Operators that SQL does not cover, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import chunk, hashing
from lectern.operators import registry, retrieval
from lectern.sources.tables import numbered


def windows_of(pieces, size, overlap):
    """Runs of pieces no longer than ``size``; each begins at the first piece of the last run's tail that leaves room."""
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    length = lambda i, j: ends[j - 1] - (ends[i - 1] if i else 0) if j > i else 0
    out, i, j = [], 0, 0
    while True:
        while j < len(pieces) and length(i, j + 1) <= size:
            j += 1
        out.append("".join(pieces[i:j]).strip())
        if j == len(pieces):
            return [x for x in out if x]
        i = next(k for k in range(i, j + 1) if length(k, j) <= overlap and (k == j or length(k, j + 1) <= size))


@pytest.mark.parametrize("separator, most", [("\n\n", 400), ("\n", 300), (" ", 12), ("", 1)])
def test_chunks_match_plain_windows(spark, separator, most):
    rng = random.Random(most)
    rows, want = [], {}
    for k in range(12):
        parts = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, most))) for _ in range(rng.choice([1, 5, 40, 900]))]
        rows.append((k, separator.join(parts)))
        pieces = [parts[0], *(separator + p for p in parts[1:])]
        for n, x in enumerate(windows_of(pieces, chunk.SIZE, chunk.OVERLAP)):
            want[k, n] = x
    rows += [(100, None), (101, ""), (102, " \n \n\n")]
    got = chunk.chunks(spark.createDataFrame(rows, "id long, text string"), F.col("text"), "id").collect()
    assert {(r.id, r.chunk_index): r.document for r in got} == want
    assert all(r.page == r.chunk_index + 1 for r in got)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("scoped", [False, True])
def test_scored_blocks_match_all_pairs(spark, monkeypatch, metric, scoped):
    monkeypatch.setattr(retrieval, "ASKED", 3)
    monkeypatch.setattr(retrieval, "HELD", 4)
    rng = np.random.default_rng(5)
    chunks = [(f"n{k % 3}", f"c{k % 7}", k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(60)] + [("n0", "c1", 99, None)]
    asked = [(f"q{k}", f"n{k % 4}", rng.normal(size=6).astype(np.float32).tolist()) for k in range(10)] + [("qx", None, [1.0] * 6), ("qy", "n1", None)]
    held = spark.createDataFrame(chunks, "notebook string, content_hash string, chunk_index int, embedding array<float>").repartition(3)
    found = retrieval.scored(held, spark.createDataFrame(asked, "question_id string, notebook string, embedding array<float>"), scope="notebook" if scoped else None, top=5, metric=metric)
    got = {(r.question_id, r["rank"]): (r.collection, r["index"], round(r.score, 6)) for r in retrieval.merged(found).collect()}
    want = {}
    for q, notebook, v in asked:
        if v is None:
            continue
        a, rows = np.array(v), []
        for own, c, k, w in chunks:
            if w is not None and (not scoped or own == notebook):
                b = np.array(w)
                rows.append((-(1 - ((a - b) ** 2).sum() if metric == "l2" else a @ b / np.sqrt((a @ a) * (b @ b))), c, k))
        kept = []
        for s, c, k in sorted(rows):
            if sum(x[1] == c for x in kept) < 3 and len(kept) < 5:
                kept.append((s, c, k))
        want |= {(q, n + 1): (c, k, round(float(-s), 6)) for n, (s, c, k) in enumerate(kept)}
    assert got == want


def test_signatures_of_streams(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "hot"]), f"{rng.randrange(40):04x}") for _ in range(400)] + [("a", None), ("only null", None)]
    got = {r.notebook_id: r.signature for r in hashing.content_signatures(spark.createDataFrame(rows, "notebook_id string, content_hash string")).collect()}
    want = {n: hashlib.sha256("|".join(sorted(h for m, h in rows if m == n and h)).encode()).hexdigest() for n in ("a", "b", None, "hot")}
    assert got == want


def test_numbers_over_ranges(spark):
    rows = [(k * 37 % 101, "x") for k in range(101)]
    got = numbered(spark.createDataFrame(rows, "k int, s string").repartition(7), "k", to="n").collect()
    assert sorted((r.k, r.n) for r in got) == [(k, k + 1) for k in range(101)]
    table = spark.createDataFrame([(5, "old", 1)], "id long, s string, created_at int")
    new = spark.createDataFrame([(None, "b", 9), (None, "a", 3)], "id long, s string, created_at int")
    assert sorted((r.id, r.s) for r in registry.appended(table, new).collect()) == [(6, "a"), (7, "b")]
