import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer(path=PATH):
    return Tokenizer.from_file(path)


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def laid(steps):
    """(length, rank) to (sequence, offset), one piece after another."""
    out = {}
    for length, first, each, bins, sequence, offset in steps:
        for n in range(each * bins):
            assert (length, first + n) not in out
            out[length, first + n] = sequence + n // each, offset + n % each * length
    return out


def plain_best_fit(counts, capacity):
    """Piece by piece: into the fullest sequence with room."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [k for k, r in enumerate(rooms) if r >= length]
            if fit:
                k = min(fit, key=lambda i: rooms[i])
                rooms[k] -= length
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_of_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 50])
    counts = {n: rng.randrange(1, 40) for n in range(1, capacity + 1) if rng.random() < 0.6}
    steps, total = packing.best_fit(counts, capacity)
    places = laid(steps)
    assert set(places) == {(n, k) for n, c in counts.items() for k in range(c)}
    filled = {}
    for (length, _), (sequence, offset) in places.items():
        filled.setdefault(sequence, []).append((offset, length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
    rooms = sorted(capacity - sum(n for _, n in p) for p in filled.values())
    assert set(filled) == set(range(total)) and rooms == plain_best_fit(counts, capacity) and min(rooms, default=0) >= 0


def test_plan_grows_with_lengths_not_with_pieces():
    counts = {n: 10**9 + n * 7919 for n in range(1, 2049)}
    steps, total = packing.best_fit(counts)
    assert len(steps) < 20_000
    assert total == pytest.approx(sum(n * c for n, c in counts.items()) / 2048, rel=2e-3)


def test_words_are_encoded_as_in_their_text():
    rng = random.Random(3)
    parts = ["it's", "Ünïcode,", "<|endoftext|>", "a<|startoftext|>b", "x", "123", "…", "été", "日本語", "́", "İstanbul", "--", "don't!", "\x00", " y", "naïve gap"]
    encoder = packing.WordEncoder(PATH)
    for _ in range(200):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "\t \r\n", ""]) for _ in range(rng.randrange(30)))
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == plain_ids(text)


def test_words_beyond_those_held(monkeypatch):
    monkeypatch.setattr(packing, "HELD_WORDS", 1)
    encoder = packing.WordEncoder(PATH)
    for text in ("one two three", "two four", "five four five one"):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == plain_ids(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pack(spark, name):
    path = public_tokenizers.path(name)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "gamma's", "42"]) for _ in range(rng.choice([0, 1, 3, 9, 40]))) for _ in range(150)] + [None, "", "word " * 700]
    rows = [(k, t, k, 1) for k, t in enumerate(texts)] + [(None, "no id", 0, 0), (3, texts[3], 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, part int").repartition(5)
    packed = packing.pack(docs, path, capacity=64, end=9)
    got = packed.collect()
    tok = tokenizer(path)
    want = sorted((str(i), k // 64, k, ids[k : k + 64]) for i, t, *_ in rows for ids in [tok.encode(t or "", add_special_tokens=False).ids + [9]] for k in range(0, len(ids), 64))
    assert sorted((str(r.doc_id), r.piece, r.start, r.ids) for r in got) == want
    assert all(len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.ids))
    for s in packing.sequences(packed).collect():
        parts = sorted(held.pop(s.sequence_id))
        assert s.starts == [o for o, _ in parts] == [0, *np.cumsum([len(x) for _, x in parts])[:-1].tolist()]
        assert s.ids == [x for _, p in parts for x in p] and len(s.ids) <= 64
    assert not held
    tokens = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= 1 + tokens * 11 // (9 * 64)


def test_empty_table_and_one_hot_length(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH).collect() == []
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text")).repartition(6)
    got = packing.pack(same, PATH, capacity=10, with_ids=False)
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    assert got.select("sequence_id", "offset").distinct().count() == 3000 and got.select("sequence_id").distinct().count() == 1000


def test_query_against_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = queries.op11_pack(spark, sf_dir).collect()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = [*plain_ids(r.text), 0]
        want += [(r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in map(sorted, held.values()):
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= 2048
    assert len(held) <= -(-sum(r.length for r in got) // 2048) + 2
