"""Operators on small tables with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import admin, chat, context, registry, retrieval


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_registry(spark):
    sources = spark.createDataFrame([(2, "n2", "h", "late"), (1, "n1", "h", "first"), (3, "n1", "g", "x")], "id long, notebook_id string, content_hash string, text string")
    got = {r.content_hash: r for r in registry.registry(sources).collect()}
    assert got["h"].extracted_text == "first" and got["h"].n_refs == 2 and got["g"].char_count == 1
    entries = spark.createDataFrame([("h", "old text")], "content_hash string, extracted_text string")
    new = spark.createDataFrame([("h", "new", 1), ("k", "b", 3), ("k", "a", 2)], "content_hash string, extracted_text string, id long")
    assert rows(registry.get_or_create(entries, new), "id") == [("k", "a", 2)]
    assert rows(registry.orphans(got_entries(spark), sources), "content_hash") == [("z",)]
    assert rows(registry.orphaned_by(sources.where("id <> 3"), sources.where("id = 3")), "content_hash") == [("h",)]


def got_entries(spark):
    return spark.createDataFrame([("h",), ("z",)], "content_hash string")


def test_updates(spark):
    table = spark.createDataFrame([(1, "queued", "err"), (2, "queued", None)], "id long, status string, error_message string")
    changes = spark.createDataFrame([(1, "ready", None)], "id long, status string, error_message string")
    assert rows(registry.updated(table, changes), "id") == [(1, "ready", "err"), (2, "queued", None)]
    assert rows(registry.upserted(table, changes, "id"), "id") == [(1, "ready", None), (2, "queued", None)]
    new = spark.createDataFrame([("a", None, 2), ("b", None, 1)], "status string, error_message string, created_at int")
    assert rows(registry.appended(table, new).select("id", "status"), "id") == [(3, "b"), (4, "a")]


@pytest.mark.parametrize("lengths,limit,used,total", [([4, 4, 4, 4], 10, 2, 8), ([1000, 2], 100, 1, 1000), ([0, 5, 5], 10, 2, 10), ([6, 6, 1], 10, 1, 6)])
def test_budget(spark, lengths, limit, used, total):
    texts = spark.createDataFrame([(k, 1, "x" * n) for k, n in enumerate(lengths)], "id long, notebook_id long, text string")
    got = context.budget_summary(texts, limit).first()
    assert (got.used_count, got.total_chars, got.total_count) == (used, total, sum(n > 0 for n in lengths))


def test_retrieval(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    chunks = spark.createDataFrame([(f"h{k % 4}", k // 4, k % 3 or None, f"t{k}", v.tolist()) for k, v in enumerate(vectors)], "content_hash string, chunk_index int, page int, document string, embedding array<float>")
    asked = spark.createDataFrame([(q, vectors[q].tolist()) for q in (0, 5)], "question_id long, embedding array<float>")
    got = retrieval.merged(retrieval.scored(chunks, asked)).orderBy("question_id", "rank").collect()
    for q in (0, 5):
        score = 1 - ((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1)
        best = []
        for c in range(4):
            best += sorted(((-score[k], f"h{c}", k // 4) for k in range(60) if k % 4 == c))[:3]
        want = [(h, i) for _, h, i in sorted(best)[:5]]
        own = [r for r in got if r.question_id == q]
        assert [(r.collection, r["index"]) for r in own] == want and all(abs(r.score - score[r["index"] * 4 + int(r.collection[1])]) < 1e-9 for r in own)
    files = spark.createDataFrame([(2, "h0", "b.txt"), (1, "h0", "a.txt"), (3, "h1", "c.txt")], "id long, content_hash string, filename string")
    found = retrieval.with_provenance(retrieval.merged(retrieval.scored(chunks, asked)), chunks, files)
    assert all(r.filename == {"h0": "a.txt", "h1": "c.txt"}.get(r.collection, "unknown") for r in found.collect())
    assert retrieval.scored(chunks, asked.limit(0)).count() == 0 and retrieval.scored(chunks.limit(0), asked).count() == 0


def test_blocks_of_questions(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ASKED", 2)
    chunks = spark.createDataFrame([("h", k, [float(k), 0.0]) for k in range(6)], "content_hash string, chunk_index int, embedding array<float>")
    asked = spark.createDataFrame([(q, [float(q), 0.0]) for q in range(6)], "question_id long, embedding array<float>")
    best = retrieval.merged(retrieval.scored(chunks, asked)).where("rank = 1")
    assert rows(best.select("question_id", "index", "score"), "question_id") == [(q, q, 1.0) for q in range(6)]


def test_recovery(spark):
    entries = spark.createDataFrame([("a", "text of a"), ("b", "text of b"), ("c", "")], "content_hash string, extracted_text string")
    have = spark.createDataFrame([("b",)], "content_hash string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "content_hash string")
    lost = retrieval.missing_collections(wanted, have, entries)
    assert rows(retrieval.rebuilt(lost), "content_hash") == [("a", 0, 1, "text of a")]


def test_context_and_citations(spark):
    hits = spark.createDataFrame([(1, 2, "a", 1, "second"), (1, 1, "a", 1, "first"), (1, 3, "b", None, "third")], "question_id long, rank int, filename string, page int, text string")
    assert context.context_strings(hits).first().context == "[Source 1] (a, Page 1)\nfirst\n\n[Source 2] (a, Page 1)\nsecond\n\n[Source 3] (b)\nthird"
    assert rows(context.citations(hits), "rank") == [(1, "a", 1, 1), (1, "b", None, 3)]


def test_answers(spark):
    texts = spark.createDataFrame([(1, "Databases store rows in tables")], "notebook_id long, text string")
    asked = spark.createDataFrame([("q1", 1, "What do databases store?"), ("q2", 1, "hello databases"), ("q3", 1, "tables?"), ("q4", 2, "tables?")], "question_id string, notebook_id long, question string")
    scoped = chat.in_scope(asked, texts)
    assert rows(scoped.select("question_id", "in_scope"), "question_id") == [("q1", True), ("q2", False), ("q3", True), ("q4", False)]
    contexts = spark.createDataFrame([("q1", "Databases store rows")], "question_id string, context string")
    got = {r.question_id: r.answer for r in chat.answers(scoped, contexts, F.lit("databases store rows")).collect()}
    assert got["q1"] == "databases store rows" and got["q2"] == got["q4"] == chat.OUT_OF_SCOPE and got["q3"] == chat.NO_INFORMATION
    frames = rows(chat.stream_frames(chat.answers(scoped, contexts, F.lit("two words"))).where("question_id = 'q3'").select("seq", "payload"), "seq")
    # an answer without a model behind it is one token
    assert frames == [(0, '{"token":"%s"}' % chat.NO_INFORMATION), (1, '{"done":true}')]
    frames = rows(chat.stream_frames(chat.answers(scoped, contexts, F.lit("two words"))).where("question_id = 'q1'").select("seq", "payload"), "seq")
    assert [x for _, x in frames][:2] == ['{"token":"two "}', '{"token":"words "}'] and "not be fully verified" in frames[2][1] and frames[3:] == [(3, '{"done":true}')]
    stored = chat.as_messages(chat.answers(scoped, contexts).withColumn("sources", F.array(F.struct(F.lit("f").alias("filename"), F.lit(1).alias("page")))))
    pair = stored.where("question_id = 'q1'").orderBy("seq").collect()
    assert [r.role for r in pair] == ["user", "assistant"] and pair[0].sources_json is None
    assert [tuple(x) for x in stored.where("seq = 1").select(chat.parsed_sources(F.col("sources_json")).alias("s")).first().s] == [("f", 1)]
    assert spark.range(1).select(chat.error_frame(F.lit("x"))).first()[0] == '{"error":"x","done":true}'


def test_history(spark):
    messages = spark.createDataFrame([(n, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for n in (1, 2) for k in range(150)], "notebook_id long, id long, role string, content string")
    first = chat.history(messages, order=("id",))
    assert first.count() == 200 and first.agg(F.max("id")).first()[0] == 99
    assert chat.pairs(messages, order=("id",)).count() == 150


def test_admin(spark):
    users = spark.createDataFrame([(1, "a", "x", "admin"), (2, "b", "y", "user"), (3, "c", "z", "disabled")], "id long, username string, password_hash string, role string").withColumn("created_at", F.col("id"))
    notebooks = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id long, user_id long")
    sources = spark.createDataFrame([(10,), (10,), (12,)], "notebook_id long")
    got = {r.id: (r.n_notebooks, r.n_sources) for r in admin.dashboard(users, notebooks, sources).collect()}
    assert got == {1: (2, 2), 2: (1, 1), 3: (0, 0)}
    assert rows(users.select(admin.disabled(F.col("role")), admin.enabled(F.col("role")), admin.may_sign_in(F.col("role"))), "role") == [("admin", "admin", True), ("disabled", "user", False), ("disabled", "user", True)]
    assert "password_hash" not in admin.listed_users(users).columns and admin.newest_first(users).first().id == 3
    assert spark.range(1).select(admin.valid_name(F.lit("")), admin.valid_password(F.lit("12345678"))).first() == (False, True)
    assert rows(admin.owned(notebooks, F.lit(1)), "id") == [(10, 1), (11, 1)]
