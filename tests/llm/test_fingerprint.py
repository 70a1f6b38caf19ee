import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprint


def canon(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).lower()).strip()


def brute(rows):
    """rows: (id, text), ids distinct and not null."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), canon(text), canon(edited), float(canon(text) == canon(edited)), float(canon(text) == canon(after)))
    return out


def agrees(df, rows, **more):
    got = {r.doc_id: r for r in fingerprint.fingerprints(df, **more).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert (g.n_chars, g.edited_sha256, g.near_edited, g.near_next) == (w[0], w[1], w[4], w[5])
    names = [(g.fingerprint, want[i][2]) for i, g in got.items()] + [(g.edited_fingerprint, want[i][3]) for i, g in got.items()]
    assert len({a for a, _ in names}) == len({b for _, b in names}) == len(set(names))


ROWS = [(1, "Hello  World"), (2, "hello world\n"), (7, None), (9, ""), (12, "café au lait"), (13, "café AU lait"), (-4, "x" * 5000), (30, "ab"), (31, "🙂🙂🙂 ok"), (5, "hello world!")]


def test_small(spark):
    agrees(spark.createDataFrame(ROWS, "doc_id long, text string"), ROWS)


def test_one_and_none(spark):
    docs = spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")
    row = fingerprint.fingerprints(docs).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert fingerprint.fingerprints(docs.limit(0)).collect() == []


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    weak = lambda c: F.pmod(F.length(c), F.lit(2)).cast("string").cast("binary")
    docs = spark.createDataFrame([(1, "aa"), (2, "aa "), (3, "bb"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs, hash_of=weak).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_repeats_nulls_and_clashing_columns(spark):
    rows = [(1, "same text", "q", 1), (1, "same text", "q", 2), (1, "other", None, 3), (None, "zzz", "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, k int")
    out = fingerprint.fingerprints(docs).collect()
    assert len(out) == 4 and len({r.edited_sha256 for r in out if r.n_chars == 9}) == 1


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    agrees(docs, [(r.doc_id, r.text) for r in docs.collect()])
