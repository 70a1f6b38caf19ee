import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import line_dedup as ld
from lectern.llm.common import scratch, setting


def key(line):
    k = line.encode().strip(b" \t\n\v\f\r").lower()
    return k if len(k.decode()) >= 10 else None


def brute(rows):
    owner = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x) is not None:
                owner[key(x)] = min(i, owner.get(key(x), i))
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_matches_brute_force(spark, batches):
    rng = random.Random(batches)
    lines = [f"{rng.choice(['A', 'a', ' a', 'a\t'])} line of number {rng.randrange(30)}" for _ in range(200)] + ["short", "", "äöüßéàèìòù", "äöüßéàèì", "ÄÖÜSSÉÀÈÌÒÙ"]
    rows = [(k * 7 % 101, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for k in range(60)] + [(200, None), (-5, "")]
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, hash string, owner int")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in ld.dedup_lines(docs, batches).collect()}
    assert got == brute(rows)


def test_runs_are_compacted_and_stay_few(spark):
    runs = ld.LineRuns(spark, scratch(spark, "runs"), fanout=2)
    seen = {}
    for b in range(9):
        rows = [(10 * b + k, bytes([b % 3, k % 4, 0])) for k in range(8)] + [(10 * b + 9, bytes([b, 9, 9]))]
        gone = {(r.id, bytes(r.hash)) for r in runs.add(spark.createDataFrame(rows, "id long, hash binary")).collect()}
        want = set()
        for i, h in sorted(rows):
            if seen.setdefault(h, i) != i:
                want.add((i, h))
        assert gone == want
        assert len(runs.runs()) == bin(b + 1).count("1")
    every = [r for run in runs.runs() for r in run.collect()]
    assert {bytes(r.hash): r.owner for r in every} == seen and len(every) == len(seen)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(4, "a shared line\nx"), (4, "a shared line\ny"), (None, "a shared line\nz"), (9, "A SHARED LINE \nx"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_dropped, r.kept_text) for r in ld.dedup_lines(docs).collect())
    assert got == sorted([("4", 0, "a shared line\nx"), ("4", 0, "a shared line\ny"), ("None", 0, "a shared line\nz"), ("9", 1, "x"), ("None", 0, "")])
    assert ld.dedup_lines(docs.limit(0)).collect() == []
    assert ld.dedup_lines(docs.where(F.col("doc_id").isNull())).count() == 2


def test_runs_are_neither_shuffled_nor_sorted_again(spark):
    runs = ld.LineRuns(spark, scratch(spark, "runs"), buckets=4)
    for b in range(3):
        runs.add(spark.createDataFrame([(10 * b + k, bytes([b, k])) for k in range(8)], "id long, hash binary"))
    with setting(spark, ld.SORTED_BUCKETS, "true"):
        own = spark.table(runs._write(spark.createDataFrame([(bytes([1, k]), k, k) for k in range(10)], "hash binary, owner long, last long").repartition(4, "hash")))
        merged = ld._merged(*runs.runs())
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (runs.unseen(own), merged)]
        assert {bytes(r.hash)[1] for r in runs.unseen(own).collect()} == {8, 9}
    for plan in plans:
        assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan
    runs.drop()
    assert not runs.runs()
