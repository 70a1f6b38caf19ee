"""Each stage, and the whole pipeline, against plain Python over the same rows."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lectern.llm import quality

STAGE = dict(cp.STAGES)


def words(text):
    return (text or "").encode().split()


def quality_of(rows):
    out = []
    for r in rows:
        w = words(r["text"])
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + j for i, g in enumerate(grams) for j in range(3) if grams.count(g) > 1} if len(grams) < 400 else _again(grams)
        if len(w) < 50 or 100 * len(again) > 50 * len(w):
            continue
        lines = r["text"].split("\n")
        keep = [x for x in lines if not words(x) or not quality.line_fails(x.encode())]
        if len(w) - sum(len(words(x)) for x in keep) <= 0.5 * len(w):
            out.append({**r, "text": "\n".join(keep), "n_chars": len("\n".join(keep))})
    return out


def _again(grams):
    at = {}
    for i, g in enumerate(grams):
        at.setdefault(g, []).append(i)
    return {i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)}


def key(line):
    k = line.encode().strip(b" \t\n\v\f\r").lower()
    return k if len(k.decode()) >= 10 else None


def line_dedup_of(rows):
    owner = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if key(x) is not None:
                owner[key(x)] = min(r["doc_id"], owner.get(key(x), r["doc_id"]))
    out = []
    for r in rows:
        text = "\n".join(x for x in (r["text"] or "").split("\n") if owner.get(key(x), r["doc_id"]) == r["doc_id"])
        out.append({**r, "text": text, "n_chars": len(text)})
    return out


def near_dup_of(rows):
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def mixing_of(rows):
    size = {r["doc_id"]: len(words(r["text"])) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    left, free, target = sum(total.values()), set(sources), {}
    while True:
        w = sum(weight[s] for s in free)
        over = {s for s in free if 3 * total[s] * w < weight[s] * left}
        if not over:
            break
        for s in over:
            target[s] = float(3 * total[s])
        left -= sum(3 * total[s] for s in over)
        free -= over
    target |= {s: weight[s] * float(left) / w for s in free}
    out = []
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest())
        whole = min(3, int(target[s] // total[s])) if total[s] else 0
        start, part = 0, int(target[s] - whole * total[s] + 0.5)
        for r in own:
            n = size[r["doc_id"]]
            taken = n * whole + max(0, min(n, part - start))
            start += n
            out += [r] * (int(taken / n + 0.5) if n else 0)
    return out


def bpe_of(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        out.append({"doc_id": r["doc_id"], "ids": ids, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()})
    return out


BRUTE = {"quality": quality_of, "line_dedup": line_dedup_of, "near_dup": near_dup_of, "mixing": mixing_of, "bpe": bpe_of}


def canonical(rows):
    return sorted(str(sorted((r if isinstance(r, dict) else r.asDict()).items())) for r in rows)


def test_whole_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for name, _ in cp.STAGES:
        rows = BRUTE[name](rows)
    got = cp.run(spark, sf).collect()
    assert len(got) > 50 and canonical(got) == canonical(rows)


LONG = " ".join(f"word{k}." for k in range(60))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stage_on_odd_rows(spark, name):
    """Nulls in any column, empty and long texts, ties, repeats, clashing columns, no rows."""
    texts = [LONG, LONG + " more.", "", "a shared line here\nb", "A SHARED line here \nc", "!!\n" * 40, "x" * 50_000, (LONG + "\n") * 30, "ß é 🙂 " * 30]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t), 5, "z") for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, hash string"
    docs = spark.createDataFrame(rows, schema)
    dicts = [r.asDict() for r in docs.collect()]
    got = STAGE[name](spark, docs, "").collect()
    assert canonical(got) == canonical(BRUTE[name](dicts))
    odd = spark.createDataFrame([*rows, rows[0], (None, LONG, None, None, None, None, None), (50, None, None, None, None, None, None), (None, None, None, None, None, None, None)], schema)
    out = STAGE[name](spark, odd, "")
    assert out.count() >= len(got) - 3 and (name == "bpe" or out.columns == docs.columns)
    assert STAGE[name](spark, odd.limit(0), "").collect() == []
