import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import language_id as li


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    scores, a = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    lengths = [4, 2, 1]
    inside = np.arange(4) < np.array(lengths)[:, None]
    p, pairs = li.marginals(scores, inside, a)
    want_pairs = np.zeros((3, 3))
    for k, n in enumerate(lengths):
        weight, own, joint = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for ys in itertools.product(range(3), repeat=n):
            w = np.exp(sum(scores[k, t, y] for t, y in enumerate(ys)) + sum(a[x, y] for x, y in zip(ys, ys[1:])))
            weight += w
            for t, y in enumerate(ys):
                own[t, y] += w
            for x, y in zip(ys, ys[1:]):
                joint[x, y] += w
        assert np.allclose(p[k, :n], own / weight)
        want_pairs += joint / weight
    assert np.allclose(pairs, want_pairs)


def test_messages_make_pieces_one_chain():
    rng = np.random.default_rng(1)
    words = [1000, 64, 3, 129, 128]
    a = rng.normal(size=(3, 3))
    scores = [rng.normal(size=(1, k, 3)) for k in words]
    pieces = np.array([-(-k // li.CHAIN) for k in words])
    cut, inside = np.zeros((pieces.sum(), li.CHAIN, 3)), np.zeros((pieces.sum(), li.CHAIN), bool)
    for x, at in zip(scores, np.cumsum(pieces) - pieces):
        for t in range(x.shape[1]):
            cut[at + t // li.CHAIN, t % li.CHAIN], inside[at + t // li.CHAIN, t % li.CHAIN] = x[0, t], True
    p, _ = li.marginals(cut, inside, a, *li.messages(cut, inside, a, pieces), count=False)
    whole = np.concatenate([li.marginals(x, np.ones(x.shape[:2], bool), a)[0][0] for x in scores])
    assert np.allclose(p[inside], whole)
    assert not np.allclose(li.marginals(cut, inside, a)[0][inside], whole)


def test_text_is_one_chain():
    rng = np.random.default_rng(2)
    field = li.Field(["en", "fr"], rng.normal(size=(li.TABLE, 2)).astype(np.float32), rng.normal(size=(2, 2)), set())
    words = ["".join(rng.choice(list("abc"), 4)) for _ in range(1000)]
    labeller = li.Labeller(field)
    p, counts = labeller.probabilities(pa.array(["ab", " ".join(words), "", "a b c " * 50]))
    assert counts.tolist() == [1, 1000, 0, 150]
    row = np.array([labeller.row_of[w] for w in words])
    want, _ = li.marginals(labeller.rows[row][None].astype(float), np.ones((1, 1000), bool), field.transitions)
    assert np.allclose(p[1:1001], want[0], atol=1e-4)


@pytest.fixture(scope="module")
def rows(spark):
    return [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in li.language_id(docs).collect()}
    assert len(got) == len(rows)
    tested = [r for r in rows if held(r.doc_id) and r.lang]
    assert all(got[r.doc_id].held_out == held(r.doc_id) for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_words(rows):
    learn = [r for r in rows if not held(r.doc_id) and r.lang and len(r.text) < 8000]
    field = li.fit([r.text for r in learn], [r.lang for r in learn])
    rng, good, total = random.Random(1), 0, 0
    for _ in range(60):
        words, langs = [], []
        for r in rng.sample([r for r in rows if held(r.doc_id) and len(r.text.split()) > 60], 3):
            own = [w for w in r.text.split() if li.LETTER.search(w)][: rng.randint(8, 30)]
            words += own
            langs += [r.lang] * len(own)
        p, _ = li.Labeller(field).probabilities(pa.array([" ".join(words)]))
        good += sum(field.langs[k] == y for k, y in zip(p.argmax(axis=1), langs))
        total += len(langs)
    assert good / total > 0.95


def test_odd_rows(spark):
    texts = ["the cat and the dog", "le chat et le chien", None, "", "123 !?", "the dog\n" * 300, "x" * 20000]
    rows = [(k if k < 6 else None, t, ["en", "fr"][k % 2] if k < 2 else None, 1) for k, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = li.language_id(docs).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 4)) for r in got if r.doc_id is not None and r.doc_id < 6 and r.doc_id > 1)
    nothing = li.language_id(docs.limit(0))
    assert nothing.collect() == [] and nothing.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r.lang_pred for r in li.identify(docs, None).collect()} == {"und"}


def test_many_languages_fit_in_bounded_arrays(monkeypatch):
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for k in range(40):
        letters_ = [chr(97 + k % 26), chr(97 + k // 26 + 3), chr(0x430 + k % 30)]
        for _ in range(6):
            texts.append(" ".join("".join(rng.choice(letters_, 5)) for _ in range(60)))
            labels.append(f"l{k:03d}")
    sizes = []
    before = li.marginals
    monkeypatch.setattr(li, "marginals", lambda scores, *a, **b: sizes.append(scores.size) or before(scores, *a, **b))
    field = li.fit(texts, labels, max_cells=40 * 4_000)
    assert len(field.langs) == 40 and max(sizes) <= 40 * (4_000 + li.CHAIN)
    langs, _ = li.Labeller(field).label(pa.array(texts[::6]))
    assert sum(a == b for a, b in zip(langs, labels[::6])) >= 34
