"""Sums over ranges, lookups, references, removal of stored collections, scopes of tables in threads."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import context, registry, retrieval
from lectern.plans import queries
from lectern.sources import tables
from lectern.sources.tables import remove, running_sums, scope, stored


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.randrange(50)) for k in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    summed = running_sums(spark.createDataFrame(rows, "n string, id int, v int").repartition(3), ["n"], ["id"], "v", "running")
    got = {(r.n, r.id): r.running for r in summed.collect()}
    hot = summed.where("n = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    totals, want = {}, {}
    for n, k, v in sorted(rows, key=lambda r: r[1]):
        totals[n] = want[n, k] = totals.get(n, 0) + v
    assert got == want and hot > 1


def test_budget_of_one_notebook_with_all_rows(spark):
    rows = [("n", k, "x" * (1 + k % 7)) for k in range(3000)] + [("big", 0, "y" * 500), ("big", 1, "z"), ("none", 2, ""), (None, 3, "q"), (None, 4, None)]
    texts = spark.createDataFrame(rows, "notebook_id string, id long, text string")
    got = {}
    for r in context.within_budget(texts, 100).collect():
        got.setdefault(r.notebook_id, {})[r.id] = r.running
    running, want = 0, {}
    for k in range(3000):
        running += 1 + k % 7
        if running > 100:
            break
        want[k] = running
    assert got == {"n": want, "big": {0: 500}, None: {3: 1}}


def test_lookups_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "Ann", "h1"), (2, "ann", "h2"), (3, None, "h1")], "id long, name string, h string").write.parquet(str(tmp_path / "t"))
    users = spark.read.parquet(str(tmp_path / "t"))
    one = registry.found(users, name="ann", h="h2")
    assert [r.id for r in one.collect()] == [2] and "EqualTo(name,ann), EqualTo(h,h2)" in one._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(name), IsNotNull(h), ", "")
    assert registry.found(users, name=None).count() == 0 and registry.found(users, name="ANN").count() == 0


def test_other_references_and_admins(spark):
    rows = [(1, "a", "h"), (2, "a", "h"), (3, "b", "h"), (4, None, "h"), (5, None, "h"), (6, "a", None), (7, "b", "x")]
    got = {r.id: (r.here, r.elsewhere) for r in registry.other_references(spark.createDataFrame(rows, "id long, notebook_id string, content_hash string")).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (0, 4), 4: (1, 3), 5: (1, 3), 6: (0, 0), 7: (0, 0)}
    users = spark.createDataFrame([(3, "x", "user", "p", 1)], "id long, username string, role string, password_hash string, extra int")
    twice = registry.seeded_admin(registry.seeded_admin(registry.seeded_admin(users, "root", "1"), "root", "2"), "x", "3")
    assert sorted(tuple(r) for r in twice.collect()) == [(3, "x", "admin", "3", 1), (4, "root", "admin", "2", None)]
    assert [tuple(r) for r in registry.seeded_admin(users.limit(0), "root", "1").collect()] == [(1, "root", "admin", "1", None)]


def test_dropped_collections(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [(f"{k % 5:02x}{k % 3}", k) for k in range(30)]
    spark.createDataFrame(rows, "content_hash string, chunk_index int").withColumn("prefix", F.substring("content_hash", 1, 2)).write.partitionBy("prefix").parquet(path)
    before = {f: os.path.getmtime(os.path.join(path, f)) for f in os.listdir(path) if f.startswith("prefix=")}
    retrieval.drop_collections(spark, path, spark.createDataFrame([("000",), ("001",), ("002",), ("011",), ("zz",)], "content_hash string"))
    left = sorted((r.content_hash, r.chunk_index) for r in spark.read.parquet(path).collect())
    assert left == sorted(r for r in rows if r[0] not in ("000", "001", "002", "011"))
    after = {f: os.path.getmtime(os.path.join(path, f)) for f in os.listdir(path) if f.startswith("prefix=")}
    assert "prefix=00" not in after and all(after[f"prefix={k:02x}"] == before[f"prefix={k:02x}"] for k in (2, 3, 4))
    retrieval.reset(spark, path)
    assert not os.path.exists(path)


def test_scopes_of_threads_do_not_meet(spark):
    there = lambda df: os.path.isdir(df._written_to.removeprefix("file:"))

    def run(k):
        with scope(spark):
            own = stored(spark.range(k + 1), "own")
            inner = [stored(spark.range(3), "inner") for _ in range(3)]
            with scope(spark):
                stored(spark.range(2), "gone")
            return own.count() == k + 1 and all(map(there, [own, *inner])), [own, *inner]

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(run, range(8)))
    assert all(ok for ok, _ in got) and not any(there(x) for _, xs in got for x in xs)
    try:
        with scope(spark) as kept:
            lost = kept(stored(spark.range(1), "lost"))
            raise KeyError
    except KeyError:
        assert not there(lost)
    free = stored(spark.range(1), "free")
    assert there(free)
    remove(spark, free._written_to)
    assert not there(free)


def test_functions_over_tables_get_batches_of_bounded_bytes(spark, tmp_path):
    @F.pandas_udf("long")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    try:
        spark.conf.set(key, "67108864b")
        most = queries.table(spark, str(tmp_path), "documents").select(held("text").alias("n")).agg(F.max("n")).first()[0]
        spark.conf.set(key, "1000b")
        tables.bounded_batches(spark)
        assert most <= tables.BATCH_BYTES + 20_000 and spark.conf.get(key) == "1000b"
    finally:
        spark.conf.set(key, before)
