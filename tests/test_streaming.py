"""Streams driven over files: ingestion, status, windows, tokens and voice sessions."""

from pyspark.sql import functions as F

from lectern.streaming import ingest, status


def test_first_writer_wins_across_batches_and_restarts(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "registry", "checkpoint"))
    schema = "id long, text string"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.run_available(ingest.registering(stream, path), checkpoint)
        return {r.extracted_text: r.first_id for r in ingest.read_registry(spark, path).collect()}

    assert feed([(2, "a"), (1, "a"), (3, "b")]) == {"a": 1, "b": 3}
    assert feed([(0, "a"), (4, "c")]) == {"a": 1, "b": 3, "c": 4}


def test_filters_never_miss_and_err_rarely(spark):
    rows = spark.range(6000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    known, other = rows.limit(3000), spark.range(10_000, 13_000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    bits = 128  # 3000 hashes in 256 prefixes: about 12 of each, 48 marks in 128 bits
    filters = ingest.filter_of(known, bits)
    assert ingest.maybe_known(known, filters, bits).count() == 3000
    assert 0 < ingest.maybe_known(other, filters, bits).count() < 300
    assert ingest.maybe_known(other, ingest.filter_of(known, 1 << 20), 1 << 20).count() == 0


def test_false_positives_and_replayed_batches_change_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "registry")
    schema = "id long, text string"
    batches = [[(k, f"text {k % 40}") for k in range(60)], [(k, f"text {k % 70}") for k in range(60, 130)], [(200, None), (201, "text 3"), (202, "new")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for again in range(2):  # the second time as after a loss of the checkpoint's last commit
            stream = spark.readStream.schema(schema).parquet(source)
            checkpoint = tmp_path / "checkpoint"
            if again:
                for x in (checkpoint / "commits").glob("*"):
                    if x.name.strip(".").startswith(str(n)):
                        x.unlink()
            ingest.run_available(ingest.registering(stream, path, bits=16, digits=1), str(checkpoint))  # nearly every filter is full
    got = {r.extracted_text: (r.first_id, r.batch, r.prefix == r.content_hash[:1]) for r in ingest.read_registry(spark, path).collect()}
    want = {f"text {k}": (k, 0, True) for k in range(40)} | {f"text {k}": (next(i for i in range(60, 130) if i % 70 == k), 1, True) for k in range(40, 70)} | {"new": (202, 2, True)}
    assert got == want and ingest.read_registry(spark, path).count() == len(want)


def test_a_batch_reads_only_touched_prefixes(spark, tmp_path):
    path = str(tmp_path / "registry")
    source = str(tmp_path / "in")
    spark.createDataFrame([(k, f"t{k}") for k in range(50)], "id long, text string").write.parquet(source)
    ingest.run_available(ingest.registering(spark.readStream.schema("id long, text string").parquet(source), path), str(tmp_path / "c"))
    some = spark.createDataFrame([("ab" + "0" * 62,), ("cd" + "0" * 62,)], "content_hash string")
    plan = ingest.touched(spark, path, ingest.REGISTRY, some, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan and "IN (ab,cd)" in plan.replace("[", "").replace("prefix#", "prefix") or "ab,cd" in plan
    assert set(ingest.touched(spark, path, ingest.REGISTRY, some, 5).select("prefix").distinct().toPandas().prefix) <= {"ab", "cd"}


def test_stream_dedup(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int").write.parquet(source)
    stream = ingest.deduplicated(spark.readStream.schema("k string, v int").parquet(source), "k")
    ingest.run_available(stream.writeStream.format("parquet").option("path", out), str(tmp_path / "c"))
    assert spark.read.parquet(out).count() == 2


def test_status(spark):
    events = spark.createDataFrame([(1, "queued", 1, 1), (1, "ready", 3, 2), (1, "scripting", 2, 3), (2, "failed", 1, 4)], "job int, state string, ts int, id int")
    got = {r.job: (r.status, r.n_events) for r in status.latest(events, "job", "state", "ts", "id").collect()}
    assert got == {1: ("ready", 3), 2: ("failed", 1)}
    pairs = spark.createDataFrame([("queued", "scripting"), ("ready", "failed"), ("ready", "queued"), ("synthesizing", "scripting"), ("scripting", "failed")], "a string, b string")
    assert [r[0] for r in pairs.select(status.allowed(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True]


def test_tokens(spark):
    lines = spark.createDataFrame([(1, '{"message":{"content":"Hi "},"done":false}'), (2, "broken"), (3, '{"message":{"content":"you"},"done":true}')], "seq int, value string")
    assert [tuple(r) for r in status.tokens(lines).orderBy("seq").collect()] == [(1, "Hi ", False), (3, "you", True)]


def test_voice_sessions(spark, tmp_path):
    schema = "sid string, seq long, event string, notebook_id long, authenticated boolean, owner boolean"
    rows = [
        ("s", 1, "connect", None, True, True), ("s", 2, "start", 7, True, True), ("s", 3, "audio", None, True, True), ("s", 4, "stop", None, True, True), ("s", 5, "cancel", None, True, True),
        ("t", 1, "connect", None, False, False), ("u", 1, "start", 9, True, False), ("u", 2, "start", None, True, True), ("u", 3, "disconnect", None, True, True),
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schema).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = status.voice_replies(spark.readStream.schema(schema).parquet(source))
    ingest.run_available(stream.writeStream.format("parquet").option("path", out), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [
        ("s", 2, "ready"), ("s", 3, "error: audio must be sent via HTTP POST /voice/turn"), ("s", 4, "sending"), ("s", 5, "cancelled"),
        ("t", 1, "rejected"), ("u", 1, "error: not owner"), ("u", 2, "error: notebook_id required"),
    ]
