import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lectern.llm import token_counts as tc

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "Hello  world", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "it's\nwe'll\t\tQ", "日本語 テキスト　a", "café cafe ́x",
    "ΟΔΟΣ ΣΑΣ", "\x85x \x1cy", "x" * 3000, "12 345!?", "İstanbul I", "<|endof text|>", "a b",
]


def expected(path, texts):
    if path == PIECE:
        return [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False)) for t in texts]


def test_kinds():
    assert [tc.counter_for(p) for p in (WORD, BYTE, PIECE)] == [tc.WordCounter, tc.TextCounter, tc.PieceCounter]


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_counters_match_the_libraries(path, monkeypatch):
    counter = tc.counter_for(path)(path)
    raw = [t.encode() for t in ODD]
    assert counter.counts(raw) == expected(path, ODD)
    monkeypatch.setattr(tc, "CACHE_WORDS", 1)
    assert counter.counts(raw[::-1]) == expected(path, ODD[::-1])


def test_operator_and_cache(spark, tmp_path):
    texts = [*ODD, None, "Hello world", "hello world"]
    docs = spark.createDataFrame([(k // 2 if k % 5 else None, t, "d") for k, t in enumerate(texts)], "doc_id long, text string, digest string")
    cache = str(tmp_path / "cache")
    want = sorted((str(k // 2 if k % 5 else None), len((t or "").encode()), n) for (k, t), n in zip(enumerate(texts), expected(WORD, [t or "" for t in texts])))
    for _ in range(2):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tc.token_counts(docs, WORD, cache).collect())
        assert got == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count()
    assert tc.token_counts(docs.limit(0), WORD).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in tc.token_counts(docs, WORD).collect()}
    want = expected(WORD, [r.text for r in rows])
    assert got == {r.doc_id: (n, n > 2048) for r, n in zip(rows, want)}
