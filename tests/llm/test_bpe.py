import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a  b ", "a<|endoftext|>b <|endoftext|> c", "\n\n x\n y", "it's  we'll\t\tq", "aaaa aaaaaaa" * 3,
    "日本語 テキスト　a \x1c b", "é é   x", "12 345,6 !?", "x" * 3000, "ab" * 2000, "end \n", "a foo\n", "<|endoftext|>",
    "trailing ", "tab\t x", "  nbsp  ", "a \x85b", "🙂🙂 ok",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(coder, library, texts):
    got = coder.encode_batch(texts)
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:50]
        assert coder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_odd_texts_match_the_library(library):
    same(bpe.tokenizer(PATH), library, ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAB é\n\t 　'sl1.,<|endoftext|>🙂"), max_size=40), max_size=4))
def test_random_texts_match_the_library(texts):
    same(bpe.tokenizer(PATH), Tokenizer.from_file(PATH), texts)


def test_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_UNITS", 3)
    coder = bpe.ByteBpe(PATH)
    for _ in range(2):
        same(coder, library, ODD)


def test_operator(spark, library):
    rows = [(1, "Hello <|endoftext|> world", 5), (2, None, 6), (2, "", None), (None, "ab  c", 1), (1, "Hello <|endoftext|> world", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = bpe.encode(docs, PATH).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc_id, ids, len(ids), sha, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in out)
    assert bpe.encode(docs.limit(0), PATH).collect() == []
