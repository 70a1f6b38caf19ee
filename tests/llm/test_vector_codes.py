import hashlib
import math
import random
from collections import defaultdict

import pytest

from lectern.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label string, row int, entry string"


def plain(rows, parts, entries, rounds):
    """Plain Lloyd over ``(id, vector, label)``."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[x[k * width : (k + 1) * width] for k in range(parts)] for _, x, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][k] for r in first] for k in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[k])), key=lambda e: (d(p[k], books[k][e]), e)) for k in range(parts)] for p in cut]
    for _ in range(rounds):
        at = assign()
        for k in range(parts):
            members = defaultdict(list)
            for p, a in zip(cut, at):
                members[a[k]].append(p[k])
            books[k] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else b for e, b in enumerate(books[k])]
    at = assign()
    errors = [sum(d(p[k], books[k][a[k]]) for k in range(parts)) for p, a in zip(cut, at)]
    of_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        of_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in a), e, of_label[label], digest) for (i, _, label), a, e in zip(kept, at, errors)), key=str)


def made(spark, rows, parts, entries, rounds):
    docs = spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA).repartition(3)
    df = vector_codes.vector_codes(docs, parts, entries, rounds)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 6, 2), (2, 3, 4), (16, 64, 1), (1, 5, 0), (8, 200, 3)])
def test_against_plain_lloyd(spark, parts, entries, rounds):
    rng = random.Random(parts)
    vector = lambda: [rng.choice([-1.5, -0.01, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(16)]
    rows = [(k, vector(), rng.choice(["a", "b", None])) for k in range(120)]
    rows += [(500 + k, rows[0][1], "hot") for k in range(60)] + [rows[3], (None, vector(), "b"), (-5, None, "a"), (-4, [0.0] * 15 + [None], "a"), (-3, [0.0] * 15 + [math.nan], "a"), (-2, [math.inf] * 16, None)]
    assert made(spark, rows, parts, entries, rounds) == plain(rows, parts, entries, rounds)


def test_only_members_that_change_entry_move(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "OWNED", 16)
    rng = random.Random(1)
    rows = [(k, [rng.gauss(k % 3, 0.2) for _ in range(4)], None) for k in range(200)]
    told = []
    docs = spark.createDataFrame([(*r, 3, "") for r in rows], SCHEMA)
    coded, books = vector_codes.codes(docs, 2, 8, 3, on_round=lambda k, stay, move: told.append((k, stay.count(), move.count(), stay._jdf.queryExecution().executedPlan().toString())))
    assert [k for k, *_ in told] == [1, 2] and all(s + m == 400 and 0 < m < s and "Exchange" not in plan for _, s, m, plan in told)
    back = vector_codes.decoded(coded, books).join(docs.selectExpr("vec_id as id", "embedding"), "id").collect()
    assert len(back) == 200
    for r in back:
        assert sum((math.floor(256 * x) - round(256 * y)) ** 2 for x, y in zip(r.embedding, r.decoded)) == r.error


def test_hot_entry_is_dealt_to_many_owners(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "OWNED", 8)
    rows = spark.createDataFrame([(k, [0.5, 0.25]) for k in range(400)], "row long, x array<double>").selectExpr("row", "cast(0 as int) position", "cast(0 as int) entry")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r[0] for r in vector_codes._owned(rows, 50).selectExpr("spark_partition_id() p").groupBy("p").count().select("count").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 200


def test_no_vectors_and_odd_lengths(spark):
    assert made(spark, [], 16, 64, 2) == [] and made(spark, [(1, None, "a")], 16, 64, 2) == []
    with pytest.raises(ValueError):
        made(spark, [(1, [1.0] * 15, "a")], 16, 64, 2)
    with pytest.raises(Exception, match="different lengths"):
        made(spark, [(k, [1.0] * (16 * (1 + k % 2)), "a") for k in range(40)], 16, 64, 2)
    with pytest.raises(Exception, match="not below"):
        made(spark, [(1, [1e30] * 16, "a")], 16, 64, 2)
