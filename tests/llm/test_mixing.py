import random
from fractions import Fraction

import pytest

from lectern.llm import mixing


def brute_targets(sizes, weights, budget, epochs):
    free, left, target = {s for s in sizes if weights[s] > 0}, Fraction(budget), {s: Fraction(0) for s in sizes}
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if epochs * sizes[s] < weights[s] * left / w}
        if not over:
            return target | {s: weights[s] * left / w for s in free}
        for s in over:
            target[s] = Fraction(epochs * sizes[s])
        left -= sum(epochs * sizes[s] for s in over)
        free -= over
    return target


def docs_of(spark, seed, n=300, sources=7):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s = rng.choices([*(f"s{j}" for j in range(sources - 1)), None], weights=[2**j for j in range(sources)])[0]
        rows.append((k, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 200]))) if k % 17 else None, s, 1, 2.0))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken int, target double"), rows


@pytest.mark.parametrize("seed,epochs", [(1, 3), (2, 1), (3, 2)])
def test_mix(spark, seed, epochs):
    docs, rows = docs_of(spark, seed)
    got = mixing.mix_sources(docs, max_epochs=epochs).collect()
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r[0]] for r in rows if r[2] == s) for s in sources}
    target = brute_targets(total, {s: k % 3 + 1 for k, s in enumerate(sources)}, sum(total.values()), epochs)
    source = {r[0]: r[2] for r in rows}
    taken = {s: 0 for s in sources}
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s]) and abs(r.target - float(target[s])) < 1e-6 and 0 <= r.taken <= epochs * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sources)
    again = mixing.mix_sources(docs.repartition(7), max_epochs=epochs).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_given_weights_and_budget(spark):
    docs, rows = docs_of(spark, 5)
    weights = spark.createDataFrame([("s5", 3), (None, 1), ("absent", 9)], "source string, weight long")
    got = mixing.mix_sources(docs, weights, budget=1000).collect()
    source = {r[0]: r[2] for r in rows}
    taken = {}
    for r in got:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert abs(taken["s5"] - 750) <= 1 and abs(taken[None] - 250) <= 1 and all(v == 0 for s, v in taken.items() if s not in ("s5", None))


def test_nothing_to_mix(spark):
    docs, _ = docs_of(spark, 6)
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, " ", None)], "doc_id long, text string, source string")
    assert sorted((r["size"], r.target, r.taken) for r in mixing.mix_sources(blank).collect()) == [(0, 0.0, 0)] * 3
