"""Whole asks: recovery inside, failures by question, streams that are replayed."""

import json

from pyspark.sql import functions as F

from lectern.functions import embed, generate
from lectern.functions.guard import NO_INFORMATION, OUT_OF_SCOPE
from lectern.operators import ask as asking
from lectern.operators import chat, registry
from lectern.streaming import ask as stream_asking
from lectern.streaming import ingest

DOCUMENT, QUERY = (lambda c, q=q: embed.embedder(dimension=32, query=q)(c) for q in (False, True))
ASKED = "question_id string, notebook_id string, question string"


def world(spark):
    texts = [(k, f"n{k % 3}", " ".join(f"topic{chr(97 + (k * i) % 11)} database value" for i in range(150))) for k in range(12)] + [(50, "n0", None), (51, "n1", ""), (52, "n9", "unasked words")]
    rows = spark.createDataFrame(texts, "id long, notebook_id string, text string").withColumn("content_hash", F.sha2("text", 256)).withColumn("filename", F.concat("notebook_id", F.lit(".txt")))
    entries = registry.registry(rows.where("text is not null")).select("content_hash", "extracted_text", "first_id")
    return rows.drop("text"), entries, asking.embedded(entries, DOCUMENT)


def questions(spark):
    rows = [("a", "n0", "Which database value?"), ("b", "n1", "What about topica?"), ("c", "n2", "Will it rain, weather?"), ("d", "n0", "zzz unknown"), ("e", "n7", "database?"), ("f", "n1", None), ("g", "n2", "database topicb"), ("h", "n2", " ")]
    return spark.createDataFrame(rows, ASKED)


def rows(df):
    return sorted(map(str, df.select("question_id", "in_scope", "context", "answer", "sources", "error").collect()))


def test_lost_collections_change_no_answer(spark):
    sources, entries, chunks = world(spark)
    whole = asking.ask(questions(spark), asking.Library(sources, entries, chunks), DOCUMENT, QUERY)
    lost = asking.ask(questions(spark), asking.Library(sources, entries, chunks.join(entries.where("first_id % 3 <> 0"), "content_hash", "left_semi")), DOCUMENT, QUERY)
    none = asking.ask(questions(spark), asking.Library(sources, entries, chunks.where("false")), DOCUMENT, QUERY)
    assert rows(whole.answers) == rows(lost.answers) == rows(none.answers)
    assert whole.rebuilt.count() == 0
    # what nobody asks in scope, n9 above all, is not made anew
    made = {r[0] for r in none.rebuilt.select("content_hash").distinct().collect()}
    own = {r[0] for r in sources.where("notebook_id in ('n0', 'n1', 'n2') and content_hash is not null").select("content_hash").distinct().collect()}
    assert made <= own and sources.where("notebook_id = 'n9'").first().content_hash not in made
    got = {r.question_id: r for r in whole.answers.collect()}
    assert got["a"].answer.startswith("[mock answer ") and got["a"].sources and got["c"].answer == got["d"].answer == got["e"].answer == OUT_OF_SCOPE
    assert got["f"].error == got["h"].error == asking.NO_QUESTION and got["f"].answer is None
    gone = asking.ask(questions(spark), asking.Library(sources, entries.where("extracted_text = 'x'"), chunks.where("false")), DOCUMENT, QUERY)
    assert {r.answer for r in gone.answers.where("error is null").collect()} == {OUT_OF_SCOPE}


def test_no_chunks_at_all(spark):
    sources, entries, chunks = world(spark)
    short = entries.withColumn("extracted_text", F.lit("database"))
    got = asking.ask(questions(spark), asking.Library(sources, short, chunks.where("false")), lambda c: F.lit(None).cast("array<float>"), QUERY)
    assert {r.question_id: r.answer for r in got.answers.collect()}["a"] == NO_INFORMATION


def test_stream_frames_replays_and_failures(spark, tmp_path):
    sources, entries, chunks = world(spark)
    source, checkpoint, at = str(tmp_path / "in"), tmp_path / "checkpoint", lambda x: str(tmp_path / x)
    entries, sources = (asking.stored(x, "w") for x in (entries, sources))

    def failing():
        def answer(messages):
            if "topica" in messages[-1]["content"].rpartition("Question:")[2]:
                raise ValueError("no")
            return generate.plain_stand_in_answer(messages)

        return answer

    told = []
    for n, wanted in enumerate(("question_id < 'd'", "question_id >= 'd'")):
        questions(spark).where(wanted).withColumn("asked_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(source)
        for again in range(2):
            if again:
                for x in (checkpoint / "commits").glob("*"):
                    if x.name.strip(".").startswith(str(n)):
                        x.unlink()
            stream = spark.readStream.schema(ASKED + ", asked_at timestamp").parquet(source)
            writer = stream_asking.asking(stream, sources, entries, at("chunks"), at("frames"), at("messages"), DOCUMENT, QUERY, generate.guarded(failing))
            ingest.run_available(writer, str(checkpoint))
            frames = sorted((r.question_id, r.seq, r.payload) for r in stream_asking.read_frames(spark, at("frames")).collect())
            told.append((len(frames), stream_asking.read_chunks(spark, at("chunks")).count(), stream_asking.read_messages(spark, at("messages")).count()))
    assert told[0] == told[1] and told[2] == told[3] and told[1][1] > 0
    of = {}
    for q, _, payload in frames:
        of.setdefault(q, []).append(json.loads(payload))
    assert of["b"] == [{"error": "ValueError: no", "done": True}] and of["h"] == [{"error": asking.NO_QUESTION, "done": True}]
    assert of["c"][0] == {"token": OUT_OF_SCOPE} and of["c"][1]["done"] and of["c"][1]["latency_ms"] >= 0 and len(of["c"]) == 2
    assert of["a"][0] == {"token": "[mock "} and of["a"][-1]["sources"][0]["filename"] == "n0.txt" and "".join(x["token"] for x in of["a"][:-1]).startswith("[mock answer")
    said = {(r.question_id, r.role): r for r in stream_asking.read_messages(spark, at("messages")).collect()}
    assert ("b", "user") not in said and json.loads(said["a", "assistant"].sources_json)[0]["filename"] == "n0.txt" and said["c", "assistant"].sources_json is None


def test_guarded_plug(spark):
    made = []

    def model():
        calls = {}

        def run(text):
            x = int(text)
            calls[x] = calls.get(x, 0) + 1
            if x % 7 == 0:
                raise KeyError(x)
            if x % 5 == 0 and calls[x] < 2:
                raise TimeoutError("read timed out")
            if x % 11 == 0:
                raise RuntimeError("429")
            return str(x)

        return run

    got = {r.id: r.x for r in spark.range(1, 60).withColumn("x", generate.guarded(model)(F.when(F.col("id") != 3, F.col("id").cast("string")))).collect()}
    assert got[7].error == "KeyError: 7" and (got[7].ok, got[7].attempts) == (False, 1)
    assert (got[5].ok, got[5].value, got[5].attempts) == (True, "5", 2) and (got[11].ok, got[11].attempts) == (False, 2) and (got[1].value, got[1].attempts) == ("1", 1)
    assert (got[3].ok, got[3].error, got[3].attempts) == (False, None, 0)

    def broken():
        raise OSError("no model")

    assert {r.x.error for r in spark.range(4).withColumn("x", generate.guarded(broken)("id")).collect()} == {"OSError: no model"} and not made


def test_words_are_distinct_before_they_are_shuffled_and_texts_are_not(spark):
    texts = spark.range(0, 4, 1, 4).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("notebook_id"), F.concat(F.lit("apples and pears and apples "), F.col("id").cast("string")).alias("text"))
    asked = spark.createDataFrame([("q1", "n1", "Which apples?"), ("q2", "n2", "Which plums?"), ("q3", "n9", "Which apples?")], "question_id string, notebook_id string, question string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = chat.in_scope(asked, texts)
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
        assert {r.question_id: r.in_scope for r in found.collect()} == {"q1": True, "q2": False, "q3": False}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    at = next(k for k, x in enumerate(lines) if "Generate explode(regexp_extract_all" in x)
    above = lines[:at][::-1]
    assert "HashAggregate" in "".join(above[: next(k for k, x in enumerate(above) if "Exchange" in x)])
    below = lines[at + 1 : next(k for k in range(at, len(lines)) if "Range" in lines[k])]
    assert not any("Exchange" in x for x in below), lines


def test_cutting_and_embedding_share_no_stage(spark):
    entries = spark.createDataFrame([("h1", "word " * 900), ("h2", "few")], "content_hash string, extracted_text string")
    made = asking.embedded(entries, embed.embedder(dimension=8))
    plan = made._jdf.queryExecution().executedPlan().toString()
    steps = [x for line in plan.splitlines() for x in ("ArrowEvalPython", "Exchange") if x in line]
    assert steps == ["ArrowEvalPython", "Exchange", "ArrowEvalPython"]
    assert sorted((r.content_hash, r.chunk_index, len(r.embedding)) for r in made.collect()) == [*(("h1", k, 8) for k in range(6)), ("h2", 0, 8)]
