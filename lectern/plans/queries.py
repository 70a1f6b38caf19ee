"""Queries over the test tables. Notebooks are ``documents.source``, sources its rows in the order of ``doc_id``,
vector collections are ``embeddings.label``, chats are ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunk, embed, generate, guard, hashing, markdown, scripts, text
from ..operators import admin, ann, chat, context, overview, registry, retrieval
from ..operators import ask as asking
from ..operators import ingest as ingestion
from ..sources import audio, files, images, pdf
from ..sources.config import Options
from ..sources.files import upload_verdict
from ..sources.tables import bounded_batches, spread, stored, workspace
from ..streaming import ask as stream_asking
from ..streaming import ingest, machines, status

from . import fixtures

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)  # for column functions, which do not see the session
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("notebook_id"), "text", "lang")
    return docs.withColumn("content_hash", hashing.content_hash(F.col("text")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions to the notebooks, dealt by conversation."""
    own = turns(spark, sf_dir).where("role = 'user'")
    return own.select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("notebook_id"), F.col("text").alias("question"), "conv_id", "turn"
    )


# Registry ---------------------------------------------------------------


@query
def registry_dedup(spark, sf_dir):
    return registry.registry(sources(spark, sf_dir)).select("content_hash", "collection", "first_id", "n_refs", "char_count")


@query
def collection_names(spark, sf_dir):
    h = F.col("content_hash")
    return sources(spark, sf_dir).select(F.col("id").alias("doc_id"), hashing.collection_name(h).alias("collection"), hashing.chunk_id(h, F.lit(0)).alias("first_chunk"))


@query
def shared_refcount(spark, sf_dir):
    return registry.reference_counts(sources(spark, sf_dir)).where("n_notebooks > 1")


@query
def orphan_content(spark, sf_dir):
    rows = sources(spark, sf_dir)
    return registry.orphaned_by(rows.where("notebook_id = 'src0'"), rows.where("notebook_id <> 'src0' or notebook_id is null"))


@query
def cascade_delete_counts(spark, sf_dir):
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    notebooks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("user_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("notebook_id"), "o_orderstatus")
    left = registry.delete_cascade(users, notebooks, orders, orders.where("o_orderstatus = 'F'"), users.where("id = 0"))
    counts = [d.agg(F.count("*").alias("n_left")).select(F.lit(n).alias("name"), "n_left") for n, d in zip(("users", "notebooks", "sources", "messages"), left)]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query
def dedup_matrix(spark, sf_dir):
    """Chunks exist for English texts, registry texts for ids that 3 does not divide."""
    rows = sources(spark, sf_dir).groupBy("content_hash").agg(F.bool_or(F.col("lang") == "en").alias("has_chunks"), F.max(F.when(F.col("id") % 3 != 0, F.col("text"))).alias("known"))
    return rows.select("content_hash", registry.dedup_action(F.col("has_chunks"), F.col("known")).alias("action"))


@query
def status_update(spark, sf_dir):
    """A second ingestion of odd sources reports new sizes; what it leaves null stays."""
    rows = sources(spark, sf_dir).select("id", F.lit("queued").alias("status"), F.lit(0).cast("bigint").alias("char_count"), F.when(F.col("id") % 2 == 0, "old").alias("error_message"))
    new = sources(spark, sf_dir).where("id % 3 = 0")
    new = new.select("id", registry.source_status(F.col("text"), F.lit(None).cast("string")).alias("status"), F.length("text").cast("bigint").alias("char_count"), F.lit(None).cast("string").alias("error_message"))
    return registry.updated(rows, new)


@query
def recovery_rebuild(spark, sf_dir):
    """Chunks are lost for all but English texts: what must be rebuilt."""
    rows = sources(spark, sf_dir)
    entries = registry.registry(rows)
    return registry_missing(rows, entries).select("content_hash", "char_count")


def registry_missing(rows: DataFrame, entries: DataFrame) -> DataFrame:
    return retrieval.missing_collections(rows, rows.where("lang = 'en'"), entries)


# Notebooks and users -------------------------------------------------------


@query
def notebook_source_counts(spark, sf_dir):
    return admin.source_counts(sources(spark, sf_dir))


@query
def admin_dashboard(spark, sf_dir):
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("username"))
    notebooks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("notebook_id"))
    return admin.dashboard(users, notebooks, orders)


@query
def user_sources(spark, sf_dir):
    """Sources of one user, by the join over notebooks."""
    notebooks = admin.owned(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "user_id"), F.lit(7))
    orders = table(spark, sf_dir, "orders")
    return orders.join(notebooks, orders["o_custkey"] == notebooks["c_custkey"], "left_semi").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


@query
def role_changes(spark, sf_dir):
    role = F.when(F.col("n_nationkey") % 5 == 0, "admin").when(F.col("n_nationkey") % 5 == 1, "disabled").otherwise("user")
    users = table(spark, sf_dir, "nation").withColumn("role", role)
    return users.select("n_nationkey", admin.disabled(F.col("role")).alias("after_disable"), admin.enabled(F.col("role")).alias("after_enable"), admin.may_sign_in(F.col("role")).alias("may_sign_in"))


@query
def settings_change(spark, sf_dir):
    wanted = F.concat(F.lit(" avatar-"), (F.col("c_custkey") % 12).cast("string"), F.lit(".png "))
    return table(spark, sf_dir, "customer").select("c_custkey", admin.chosen_setting(wanted, F.lit("avatar-0.png"), "avatar").alias("avatar"))


@query
def notebook_list(spark, sf_dir):
    """The ten newest notebooks with their number of sources."""
    rows = sources(spark, sf_dir).groupBy("notebook_id").agg(F.count("*").alias("n_sources"), F.max("id").alias("newest"))
    return rows.orderBy(F.desc("newest"), "notebook_id").limit(10)


@query
def status_filter(spark, sf_dir):
    state = F.when(F.length("text") > 20_000, F.lit("too long"))
    rows = sources(spark, sf_dir).withColumn("status", registry.source_status(F.col("text"), state))
    return rows.where(context.usable(F.col("status"))).groupBy("notebook_id", "status").agg(F.count("*").alias("n"))


@query
def content_signature(spark, sf_dir):
    return hashing.content_signatures(sources(spark, sf_dir))


@query
def signature_skip(spark, sf_dir):
    """Whether a summary may be kept: every third notebook got its newest source after the stored signature."""
    rows = sources(spark, sf_dir)
    grown = F.coalesce(F.expr("try_cast(substring(notebook_id, 4) as int)") % 3 == 0, F.lit(False))
    newest = rows.where(grown).groupBy("notebook_id").agg(F.max("id").alias("id"))
    before = hashing.content_signatures(rows.join(newest, ["notebook_id", "id"], "left_anti")).withColumnRenamed("signature", "old")
    after = hashing.content_signatures(rows)
    return after.join(before, "notebook_id", "left").select("notebook_id", F.coalesce(F.col("old") == F.col("signature"), F.lit(False)).alias("skipped"))


@query
def source_references(spark, sf_dir):
    """Of each source, the other sources with its content: in its notebook, and in others."""
    return registry.other_references(sources(spark, sf_dir).select("id", "notebook_id", "content_hash")).select(F.col("id").alias("doc_id"), "here", "elsewhere")


@query
def user_by_name(spark, sf_dir):
    """One user by name, as it is written and in capitals."""
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    named = lambda name: registry.found(users, c_name=name).withColumn("asked", F.lit(name))
    return named("Customer#000000007").unionByName(named("CUSTOMER#000000007"))


@query
def seeded_admins(spark, sf_dir):
    """Two administrators seeded: a user that there is, and a new one."""
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("username"), F.lit("user").alias("role"), F.lit("old").alias("password_hash"))
    return registry.seeded_admin(registry.seeded_admin(users, "NATION_3", "new"), "admin", "first")


@query
def user_list(spark, sf_dir):
    """The twenty oldest users; passwords are not shown."""
    created = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_nationkey") * 7 % 25).cast("int"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("password_hash"), created.alias("created_at"))
    return admin.listed_users(users).limit(20)


@query
def newest_sources(spark, sf_dir):
    """The twenty newest sources."""
    return admin.newest_first(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))).limit(20)


@query
def source_list(spark, sf_dir):
    """Events as sources, in the fields and form that a list shows."""
    k = F.from_json("props", "k int")["k"]
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat("event_type", F.lit(".pdf")).alias("filename"), F.lit("pdf").alias("content_type"), F.when(k % 5 == 0, "failed").otherwise("ready").alias("status"),
        (k * 100).alias("char_count"), F.when(k % 3 != 0, k).alias("page_count"), F.when(k % 5 == 0, "broken").alias("error_message"), F.when(k % 7 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts")).alias("created_at"),
    )
    return admin.listed_sources(rows.withColumn("created_at", F.when(F.col("id") % 13 != 0, F.col("created_at"))).withColumn("secret", F.lit("x")))


@query
def budget_selection(spark, sf_dir):
    return context.budget_summary(sources(spark, sf_dir))


@query
def budget_texts(spark, sf_dir):
    return context.within_budget(sources(spark, sf_dir)).select("notebook_id", F.col("id").alias("doc_id"), "chars", "running")


@query
def length_requests(spark, sf_dir):
    """What models are told of the length of a notebook's scripts."""
    chars = F.col("total_chars")
    return context.budget_summary(sources(spark, sf_dir)).select("notebook_id", text.length_request(chars).alias("dialogue"), text.length_request(chars, "slides", 90, 300).alias("slides"))


@query
def duration_target(spark, sf_dir):
    seconds = text.speech_seconds(F.col("total_chars"))
    return context.budget_summary(sources(spark, sf_dir)).select("notebook_id", seconds.alias("seconds"), text.speech_words(seconds).alias("words"))


# Guards -------------------------------------------------------------------


@query
def meaningful_words(spark, sf_dir):
    words = F.sort_array(guard.meaningful_words(F.col("text")))
    return sources(spark, sf_dir).select(F.col("id").alias("doc_id"), F.size(words).alias("n_words"), F.md5(F.array_join(words, " ")).alias("digest"))


@query
def scope_check(spark, sf_dir):
    return chat.in_scope(questions(spark, sf_dir), sources(spark, sf_dir)).select("conv_id", "turn", "in_scope")


@query
def groundedness(spark, sf_dir):
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns(spark, sf_dir).withColumn("before", F.lag("text").over(own)).where("role = 'assistant'")
    checked = guard.groundedness(F.col("text"), F.col("before"), 0.25)
    return rows.select("conv_id", "turn", checked["grounded"].alias("grounded"), F.md5(checked["result"]).alias("result"))


# Retrieval ----------------------------------------------------------------


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("label", "content_hash").withColumnRenamed("vec_id", "chunk_index")


def many_vectors(spark, sf_dir):
    """Every vector whose id 50 divides is a question."""
    return vectors(spark, sf_dir).where("chunk_index % 50 = 0").select(F.col("chunk_index").alias("question_id"), "embedding")


def best_of_each(spark, sf_dir, metric):
    own = Window.partitionBy("question_id", "collection").orderBy(F.desc("score"), "index")
    rows = retrieval.scored(vectors(spark, sf_dir), many_vectors(spark, sf_dir), metric=metric).withColumn("score", F.round("score", 6))
    best = rows.withColumn("place", F.row_number().over(own)).where("place <= 3")
    return best.select("question_id", F.col("collection").alias("label"), F.col("index").alias("vec_id"), "score", "place")


@query
def vector_topk(spark, sf_dir):
    return best_of_each(spark, sf_dir, "l2")


@query
def vector_topk_cosine(spark, sf_dir):
    return best_of_each(spark, sf_dir, "cosine")


def hits(spark, sf_dir, metric="l2"):
    found = retrieval.scored(vectors(spark, sf_dir), many_vectors(spark, sf_dir), metric=metric).withColumn("score", F.round("score", 6))
    return retrieval.merged(found)


@query
def multi_collection_topk(spark, sf_dir):
    return hits(spark, sf_dir, "cosine").select("question_id", F.col("index").alias("vec_id"), F.col("collection").alias("label"), "score", "rank")


@query
def batch_retrieval(spark, sf_dir):
    return hits(spark, sf_dir).select("question_id", F.col("index").alias("vec_id"), F.col("collection").alias("label"), "score", "rank")


@query
def ann_exact(spark, sf_dir):
    """An inverted file with all lists read: the same hits as without it."""
    index = ann.build(vectors(spark, sf_dir), workspace(spark, "index"))
    found = ann.search(many_vectors(spark, sf_dir), index, probes=len(index.centroids))
    return found.select("question_id", F.col("index").alias("vec_id"), F.col("collection").alias("label"), F.round("score", 6).alias("score"), "rank")


@query
def ann_recall(spark, sf_dir):
    """How many hits the inverted file finds that there are, with the lists that it reads by itself, and whether they are enough."""
    index = ann.build(vectors(spark, sf_dir), workspace(spark, "index"))
    found = ann.search(many_vectors(spark, sf_dir), index).select("question_id", "collection", "index", F.lit(True).alias("_found"))
    wanted = retrieval.merged(retrieval.scored(vectors(spark, sf_dir), many_vectors(spark, sf_dir), top=retrieval.TOP))
    both = wanted.join(found, ["question_id", "collection", "index"], "left")
    return both.agg(F.countDistinct("question_id").alias("n_questions"), F.count("*").alias("n_hits"), (F.count("_found") >= 0.9 * F.count("*")).alias("enough"))


def provenance(spark, sf_dir):
    """Chunk texts are documents by id; files are named for two of three collections."""
    chunks = vectors(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_index"), F.col("text").alias("document")), "chunk_index", "left")
    chunks = chunks.withColumn("document", F.coalesce("document", F.lit(""))).withColumn("page", F.when(F.col("chunk_index") % 5 != 0, F.col("chunk_index") % 7))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 15).cast("int").alias("content_hash"), F.col("source").alias("filename"))
    return retrieval.with_provenance(hits(spark, sf_dir), chunks, files.where("content_hash % 3 <> 0"))


@query
def collection_texts(spark, sf_dir):
    """The texts of the best two chunks of every collection for each question."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_index"), F.col("text").alias("document"))
    chunks_ = vectors(spark, sf_dir).join(texts, "chunk_index")
    scores = retrieval.scored(chunks_, many_vectors(spark, sf_dir), k=2).withColumn("score", F.round("score", 6))
    return retrieval.collection_texts(scores, chunks_, 2).select("question_id", F.col("collection").alias("label"), F.md5("text").alias("digest"))


@query
def collections_left(spark, sf_dir):
    """Chunks by collection when every third collection is gone from the store."""
    path = workspace(spark, "store")
    chunks_ = vectors(spark, sf_dir).select(F.sha2(F.col("content_hash").cast("string"), 256).alias("content_hash"), "chunk_index", F.col("content_hash").alias("label"))
    chunks_.withColumn("prefix", F.substring("content_hash", 1, 2)).write.partitionBy("prefix").parquet(path)
    retrieval.drop_collections(spark, path, chunks_.where("label % 3 = 0"))
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.sum("chunk_index").alias("total"))


@query
def retrieval_provenance(spark, sf_dir):
    return provenance(spark, sf_dir).select("question_id", "rank", F.col("index").alias("vec_id"), "filename", "page", "text", "score")


@query
def citation_dedup(spark, sf_dir):
    found = context.citations(provenance(spark, sf_dir))
    return found.withColumn("label", text.citation_label(F.col("filename"), F.col("page")))


@query
def context_string(spark, sf_dir):
    return context.context_strings(provenance(spark, sf_dir))


#: Dimension of the vectors of the queries that ask.
ASKED_DIMENSION = 64


def library(spark, sf_dir):
    """Notebooks as a library of which a third of the collections, those with an entry that 3 divides, are lost."""
    rows = sources(spark, sf_dir)
    entries = stored(registry.registry(rows).select("content_hash", "extracted_text", "first_id"), "entries")
    held = stored(asking.embedded(entries.where("first_id % 3 <> 0"), embed.embedder(dimension=ASKED_DIMENSION)), "chunks")
    return asking.Library(rows.select("id", "notebook_id", "content_hash", F.concat(F.col("notebook_id"), F.lit(".txt")).alias("filename")), entries, held)


def benchmark_questions(benchmark):
    return benchmark.select(F.col("item_id").alias("question_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("notebook_id"), F.col("text").alias("question"))


@query
def ask_notebooks(spark, sf_dir):
    """Whole question to answer: benchmark items asked to notebooks whose lost collections are made anew; the hash embedder embeds."""
    asked = asking.ask(benchmark_questions(table(spark, sf_dir, "benchmark")), library(spark, sf_dir), embed.embedder(dimension=ASKED_DIMENSION), embed.embedder(dimension=ASKED_DIMENSION, query=True))
    return asked.answers.select("question_id", "notebook_id", "in_scope", "answer", F.length("context").alias("context_chars"), F.size("sources").alias("n_sources"))


def strict_model():
    """The offline chat model, which refuses questions whose length 7 divides and is overloaded at first where 5 divides it."""
    calls = {}

    def answer(messages):
        question = messages[-1]["content"].rpartition(generate.QUESTION_TEMPLATE[1])[2]
        calls[question] = calls.get(question, 0) + 1
        if len(question) % 7 == 0:
            raise ValueError("refused")
        if len(question) % 5 == 0 and calls[question] % 2:
            raise RuntimeError("HTTP 429")
        return generate.plain_stand_in_answer(messages)

    return answer


@query
def stream_ask(spark, sf_dir):
    """The same questions as a stream, every eleventh blank, to a model that refuses some: all frames, also of errors."""
    path = workspace(spark, "asked")
    held = library(spark, sf_dir)
    held.chunks.withColumn("batch", F.lit(-1).cast("bigint")).write.partitionBy("batch").parquet(f"{path}/chunks")
    asked = benchmark_questions(streamed(spark, sf_dir, "benchmark")).withColumn("question", F.when(F.col("question_id") % 11 != 0, F.col("question")).otherwise(" "))
    writer = stream_asking.asking(
        asked.withColumn("question_id", F.col("question_id").cast("string")), held.sources, held.entries, f"{path}/chunks", f"{path}/frames", f"{path}/messages",
        embed.embedder(dimension=ASKED_DIMENSION), embed.embedder(dimension=ASKED_DIMENSION, query=True), generate.guarded(strict_model),
    )
    ingest.run_available(writer, f"{path}/checkpoint")
    return stream_asking.read_frames(spark, f"{path}/frames").select("question_id", "seq", "payload")


# Ingestion ------------------------------------------------------------------


@query
def chunks(spark, sf_dir):
    return chunk.chunks(sources(spark, sf_dir), F.col("text"), "id").select(F.col("id").alias("doc_id"), "chunk_index", "page", F.length("document").alias("n_chars"), F.md5("document").alias("digest"))


@query
def chunk_stats(spark, sf_dir):
    made = chunk.chunks(sources(spark, sf_dir), F.col("text"), "id")
    return made.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_chunks"), F.max("page").alias("last_page"), F.sum(F.length("document")).alias("n_chars"))


@query
def hash_embedding_norm(spark, sf_dir):
    """Length, norm and digest (components as whole millionths) of each text's vector."""
    rows = sources(spark, sf_dir).where("text <> ''").withColumn("v", embed.embedder()(F.col("text")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    digest = F.md5(F.array_join(F.transform("v", lambda x: F.floor(x.cast("double") * 1_000_000).cast("string")), ","))
    return rows.select(F.col("id").alias("doc_id"), F.size("v").alias("dim"), F.round(norm, 5).alias("norm"), digest.alias("digest"))


def token_model():
    """For each text, within a batch of one, a vector for each word: its length, its first and last code point."""
    return lambda texts: [[[[len(w), ord(w[0]), ord(w[-1])] for w in t.split() or ["-"]]] for t in texts]


@query
def token_vectors(spark, sf_dir):
    """Texts embedded by a model that gives a vector for each token."""
    v = embed.embedder(token_model)(F.col("text"))
    return sources(spark, sf_dir).select(F.col("id").alias("doc_id"), F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query
def content_type(spark, sf_dir):
    name = text.basename(F.regexp_replace("url", "[?#].*$", ""))
    named = F.concat(name, F.element_at(F.array(*map(F.lit, [".PDF", ".docx", ".xyz", "", ".tar.md"])), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", named.alias("filename"), text.content_type(named).alias("content_type"))


@query
def basename_sanitize(spark, sf_dir):
    path = F.when(F.col("page_id") % 7 == 0, F.lit("../..")).when(F.col("page_id") % 7 == 1, F.lit("a/./")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.basename(path).alias("name"))


@query
def upload_validation(spark, sf_dir):
    """Pages as uploads under invented names; some have no content, some are not what their name says."""
    kinds = F.array(*map(F.lit, ["a.html", "b.txt", "c.md", "d.pdf", "..", "", "e"]))
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(kinds, (F.col("page_id") % 7 + 1).cast("int")).alias("filename"), F.when(F.col("page_id") % 11 != 0, F.col("html").cast("binary")).alias("content"))
    rows = rows.select("*", F.length("content").cast("bigint").alias("size"), F.when(F.col("page_id") % 13 == 0, 50).otherwise(3).alias("n_sources"), (F.col("page_id") % 2 == 0).alias("known"))
    return upload_verdict(rows).select("page_id", "http_status", "error")


@query
def redact_url(spark, sf_dir):
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("postgresql://me:p@ss@"), F.substring_index("url", "://", -1))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.redact_url(url).alias("url"))


# Generation -------------------------------------------------------------------


@query
def chat_history(spark, sf_dir):
    return chat.history(turns(spark, sf_dir), "conv_id", ("turn",)).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query
def qa_pairs(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumnRenamed("text", "content")
    return chat.pairs(rows, "conv_id", ("turn",)).select("conv_id", "turn", F.col("content").alias("question"), "answer")


def prompts(spark, sf_dir):
    rows = questions(spark, sf_dir).withColumn("context", F.when(F.col("turn") % 4 == 0, F.lit("")).otherwise(F.col("notebook_id")))
    return rows.withColumn("messages", generate.prompt(F.lit(generate.SYSTEM_PROMPT), F.col("context"), F.col("question")))


@query
def prompt_build(spark, sf_dir):
    return prompts(spark, sf_dir).select("conv_id", "turn", F.md5(generate.messages_key(F.col("messages"))).alias("digest"), F.size("messages").alias("n"))


@query
def mock_answer(spark, sf_dir):
    return prompts(spark, sf_dir).select("conv_id", "turn", generate.stand_in_answer(F.col("messages")).alias("answer"))


@query
def mock_tokens(spark, sf_dir):
    tokens = generate.answer_tokens(F.col("question"))
    return questions(spark, sf_dir).select("conv_id", "turn", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, "")).alias("digest"))


@query
def sse_frames(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", text.sse_frame(F.struct(F.col("text").alias("token"))).alias("frame"))


@query
def persisted_messages(spark, sf_dir):
    rows = chat.pairs(turns(spark, sf_dir).withColumnRenamed("text", "content"), "conv_id", ("turn",))
    cited = F.array(F.struct(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("filename"), F.when(F.col("turn") % 4 != 0, F.col("turn").cast("int")).alias("page")))
    cited = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<struct<filename:string,page:int>>")).when(F.col("conv_id") % 3 == 1, cited)
    rows = rows.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("conv_id").alias("notebook_id"), F.col("content").alias("question"), "answer", cited.alias("sources"))
    return chat.as_messages(rows).select("question_id", "notebook_id", "seq", "role", F.md5("content").alias("digest"), "sources_json")


@query
def host_alternation(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    label = scripts.host(F.when(F.col("role") == "user", "Ava").otherwise("host_b"))
    return turns(spark, sf_dir).select("conv_id", pos.alias("pos"), label.alias("label")).withColumn("host", scripts.host_at(F.col("pos")))


def fenced(json):
    return F.concat(F.lit("Sure:\n```json\n"), json, F.lit("\n```"))


@query
def summary_parse(spark, sf_dir):
    """Generated summaries, every fifth broken."""
    asked = F.transform(F.sequence(F.lit(1), (F.col("turn") % 8 + 1).cast("int")), lambda k: F.concat(F.lit("q"), k.cast("string")))
    good = fenced(F.to_json(F.struct(F.col("text").alias("summary"), asked.alias("suggested_questions"))))
    rows = turns(spark, sf_dir).withColumn("raw", F.when(F.col("conv_id") % 5 == 0, F.lit(" {broken ")).otherwise(good))
    out = scripts.summary(F.col("raw"))
    return rows.select("conv_id", "turn", out["summary"].alias("summary"), F.array_join(out["suggested_questions"], ",").alias("questions"))


@query
def dialogue_parse(spark, sf_dir):
    said = F.array(F.struct(F.lit("host_a").alias("host"), F.col("text")), F.struct(F.lit("2").alias("host"), F.lit("  ").alias("text")), F.struct(F.lit("B").alias("host"), F.lit(" end ").alias("text")))
    rows = turns(spark, sf_dir).withColumn("raw", fenced(F.to_json(F.struct(said.alias("dialogue")))))
    return rows.select("conv_id", "turn", F.posexplode(scripts.dialogue(F.col("raw"))).alias("pos", "x")).select("conv_id", "turn", "pos", "x.host", "x.text")


@query
def dialogue_markers(spark, sf_dir):
    """Dialogues whose JSON breaks off or holds bare quotes: what their markers show."""
    turn = lambda host, text: F.concat(F.lit('{"host": "' + host + '" , "text" : "'), text, F.lit('"}, '))
    raw = F.concat(F.lit('{"dialogue": ['), turn("Ava", F.col("text")), turn("2", F.lit('he said "no" ')), turn("right", F.lit("  ")), F.lit('{"host":"host a","text":"'), F.col("role"), F.when(F.col("turn") % 2 == 0, '"}]} ').otherwise(""))
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(scripts.dialogue(F.when(F.col("conv_id") % 2 == 0, fenced(raw)).otherwise(raw))).alias("pos", "x"))
    return rows.select("conv_id", "turn", "pos", "x.host", F.md5("x.text").alias("digest"))


@query
def final_answers(spark, sf_dir):
    """Generated texts with thinking blocks before, inside and instead of an answer."""
    block = lambda x: F.concat(F.lit("<|channel|thought\n"), x, F.lit("<channel|>"))
    raw = F.when(F.col("turn") % 3 == 0, F.concat(block(F.col("text")), F.lit("\n "), F.col("text"), block(F.lit("more")), F.lit(" end "))).when(F.col("turn") % 3 == 1, block(F.col("role"))).otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n")))
    return turns(spark, sf_dir).select("conv_id", "turn", F.md5(text.final_answer(raw)).alias("digest"))


@query
def script_signatures(spark, sf_dir):
    """Twelve digits for what is said in a conversation, in order."""
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return turns(spark, sf_dir).groupBy("conv_id").agg(hashing.ordered_signature(said).alias("signature"))


@query
def reply_names(spark, sf_dir):
    """Names of replies' files as they are asked for, some with folders in them."""
    name = F.when(F.col("page_id") % 4 == 0, text.basename(F.col("url"))).when(F.col("page_id") % 4 == 1, F.col("url")).when(F.col("page_id") % 4 == 2, F.translate(F.col("url"), "/", "\\"))
    return table(spark, sf_dir, "pages").select("page_id", text.reply_name(F.coalesce(name, F.substring("url", 1, (F.col("page_id") % 3).cast("int")))).alias("name"))


@query
def latencies(spark, sf_dir):
    """Milliseconds between a user's events."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", text.latency_ms(before.cast("timestamp"), F.col("ts").cast("timestamp")).alias("latency_ms"))


@query
def wrapped_lines(spark, sf_dir):
    """Texts in lines of forty characters, for slides."""
    lines = markdown.wrapped(F.col("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(lines).alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("digest"))


@query
def slides_parse(spark, sf_dir):
    slide = F.struct(F.col("text").alias("heading"), F.array(F.lit(" one "), F.lit(" "), F.col("role")).alias("bullets"))
    rows = turns(spark, sf_dir).withColumn("raw", fenced(F.to_json(F.struct(F.array(slide).alias("slides")))))
    return rows.select("conv_id", "turn", F.explode(scripts.slides(F.col("raw"))).alias("x")).select("conv_id", "turn", "x.type", "x.heading", F.array_join("x.bullets", ",").alias("bullets"), "x.narration")


@query
def clean_for_tts(spark, sf_dir):
    marked = F.concat(F.lit("## Head\n- **a** [Source 1] , `c` "), F.col("text"))
    return sources(spark, sf_dir).select(F.col("id").alias("doc_id"), F.md5(text.spoken(marked)).alias("digest"))


@query
def markdown_html(spark, sf_dir):
    marked = F.concat(F.lit("## Head\n- *a*\n- b\n\n> "), F.col("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.md5(markdown.markdown_html(marked)).alias("digest"))


@query
def markdown_parts(spark, sf_dir):
    """Texts under all kinds of markup: their first words bold, as code, linked, in lists and in a block of code."""
    word = lambda k: F.coalesce(F.try_element_at(F.split("text", r"\s+"), F.lit(k)), F.lit("-"))
    parts = [F.lit("1. **"), word(1), F.lit("** and `"), word(2), F.lit("a*<b>*`\n2. ["), word(3), F.lit("](https://example.org/"), word(4), F.lit(") _"), word(5), F.lit("_ x_y_z [no](ftp://n)\n---\n### "), word(6), F.lit(" & co\n* "),
             word(7), F.lit("\n```py\n# "), word(8), F.lit(" <i>\n\n- "), word(9), F.lit("\n```\nlast *"), word(10), F.lit("*\nline\n\nnew")]
    return turns(spark, sf_dir).select("conv_id", "turn", markdown.markdown_html(F.concat(*parts)).alias("html"))


@query
def voice_map(spark, sf_dir):
    speaker = F.element_at(F.array(*map(F.lit, ["Ava", "Andrew", "Emma", "Ryan", "Nobody"])), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.voice_of(speaker).alias("voice"))


@query
def stand_in_models(spark, sf_dir):
    raw = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", generate.image_text(raw, "table").alias("image_text"), generate.speech_text(raw)["text"].alias("heard"))


@query
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("sum_k"), F.count("*").alias("n"))


# Streams ----------------------------------------------------------------------


@query
def status_latest(spark, sf_dir):
    return status.latest(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query
def events_tumbling(spark, sf_dir):
    out = status.windowed(table(spark, sf_dir, "events"), "ts", "1 day", None, None, "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def events_sliding(spark, sf_dir):
    out = status.windowed(table(spark, sf_dir, "events"), "ts", "2 days", "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query
def events_session(spark, sf_dir):
    out = status.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "1 hour")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def streamed(spark, sf_dir, name):
    """A table as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@query
def stream_registry(spark, sf_dir):
    """The registry as streaming ingestion builds it, batch by batch."""
    path = workspace(spark, "registry")
    ingest.run_available(ingest.registering(streamed(spark, sf_dir, "documents"), path, "doc_id", digits=1), path + "-checkpoint")
    return ingest.read_registry(spark, path).select("content_hash", "collection", "char_count", "first_id")


@query
def stream_distinct(spark, sf_dir):
    """Contents of a stream of documents, each told once; keys are state."""
    path = workspace(spark, "distinct")
    hashed = streamed(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"))
    ingest.run_available(ingest.deduplicated(hashed, "content_hash").writeStream.format("parquet").option("path", path), path + "-checkpoint")
    return spark.read.schema("content_hash string").parquet(path)


@query
def stream_windows(spark, sf_dir):
    """Closed daily windows of the event stream, with a watermark of a day."""
    path = workspace(spark, "windows")
    events = streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    writer = status.windowed(events, "ts", "1 day", None, "1 day").writeStream.format("parquet").outputMode("append").option("path", path)
    ingest.run_available(writer, path + "-checkpoint")
    return spark.read.schema("start timestamp, end timestamp, n bigint, total double").parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query
def voice_sessions(spark, sf_dir):
    """Replies to a stream of voice events: users as connections, kinds of events by id."""
    key, provider = status.STATE_STORE
    before = spark.conf.get(key)
    path = workspace(spark, "voice")
    kind = F.element_at(F.array(*map(F.lit, VOICE_EVENTS)), (F.col("event_id") % 6 + 1).cast("int"))
    notebook = F.when(F.col("event_id") % 7 != 0, F.col("user_id"))
    events = streamed(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sid"), F.col("event_id").alias("seq"), kind.alias("event"), notebook.cast("bigint").alias("notebook_id"),
        (F.col("event_id") % 5 != 0).alias("authenticated"), (F.col("event_id") % 11 != 0).alias("owner"),
    )
    spark.conf.set(key, provider)
    try:
        ingest.run_available(status.voice_replies(events).writeStream.format("parquet").option("path", path), path + "-checkpoint")
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(status.SESSION).parquet(path)


VOICE_EVENTS = ["connect", "start", "audio", "stop", "cancel", "disconnect"]


@query
def status_transitions(spark, sf_dir):
    """Each user's events as states of a job: which of the steps are allowed."""
    state = F.element_at(F.array(*map(F.lit, status.STATES)), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", state.alias("state"))
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = rows.withColumn("before", F.lag("state").over(own)).where("before is not null")
    return steps.select("event_id", "before", "state", status.allowed(F.col("before"), F.col("state")).alias("allowed"))


def ran(spark, machine, columns):
    """The table of what a machine tells of its stream."""
    path = workspace(spark, "machine")
    with machines.state_store(spark):
        ingest.run_available(machine.writeStream.format("parquet").option("path", path), path + "-checkpoint")
    return spark.read.schema(columns).parquet(path)


@query
def job_runs(spark, sf_dir):
    """Users as jobs on a stream: kinds of events are steps, a run that stands still for twelve hours fails."""
    steps = F.create_map(*(F.lit(x) for pair in JOB_STEPS.items() for x in pair))
    events = streamed(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), steps[F.col("event_type")].alias("state"))
    return ran(spark, machines.job_runs(events, 12 * 3600, "1 day"), machines.JobMachine.OUT)


JOB_STEPS = {"signup": "queued", "view": "scripting", "click": "synthesizing", "purchase": "ready", "error": "failed"}


@query
def voice_history(spark, sf_dir):
    """Users as voice connections on a stream: replies, and the sessions that ended, some by six hours of silence."""
    k = F.from_json("props", "k bigint")["k"]
    kind = F.when(F.col("event_type") != "error", F.create_map(*(F.lit(x) for pair in VOICE_KINDS.items() for x in pair))[F.col("event_type")]).when(k % 2 == 0, "cancel").otherwise("disconnect")
    events = streamed(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sid"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"), F.when(k % 10 != 0, k).alias("notebook_id"),
        "user_id", (F.col("value") >= 5).alias("authenticated"), (k % 4 != 0).alias("owner"),
    )
    return ran(spark, machines.voice_history(events, 6 * 3600, "1 day"), machines.VoiceMachine.OUT)


VOICE_KINDS = {"signup": "connect", "view": "start", "click": "audio", "purchase": "stop"}


@query
def ndjson_tokens(spark, sf_dir):
    """Turns as lines of a model's stream, every seventh broken."""
    line = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), (F.col("turn") % 2 == 1).alias("done")))
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, F.lit('{"message":')).otherwise(line).alias("value"))
    return status.tokens(rows).select("conv_id", "turn", F.md5("token").alias("digest"), "done")


@query
def chat_frames(spark, sf_dir):
    """Answered questions as frames with sources and latency; every third conversation is out of scope, every second cites no page."""
    rows = chat.pairs(turns(spark, sf_dir).withColumnRenamed("text", "content"), "conv_id", ("turn",))
    said = F.when(F.col("conv_id") % 3 == 0, guard.OUT_OF_SCOPE).when(F.col("turn") % 4 == 0, F.concat("answer", F.lit(guard.NOT_VERIFIED))).otherwise(F.col("answer"))
    cited = F.array(F.struct(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("filename"), F.when(F.col("conv_id") % 2 == 0, F.col("turn").cast("int")).alias("page")))
    rows = rows.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), (F.col("conv_id") % 3 != 0).alias("in_scope"), said.alias("answer"), cited.alias("sources"), F.col("turn").cast("int").alias("latency_ms"))
    return chat.stream_frames(rows)


@query
def file_ingestion(spark, sf_dir):
    """Documents as files, text and markdown by turns, every ninth of an unknown type; ingested twice."""
    kind = F.when(F.col("id") % 9 == 0, "bin").when(F.col("id") % 2 == 0, "txt").otherwise("md")
    name = F.concat(F.format_string("%012d.", "id"), kind)
    files = sources(spark, sf_dir).select(name.alias("filename"), F.col("text").cast("binary").alias("content"), "content_hash", text.content_type(name).alias("content_type"))
    options = Options(embedding_dimension=16)
    chunks_path, entries_path = workspace(spark, "chunks"), workspace(spark, "entries")
    nothing = spark.createDataFrame([], "content_hash string, extracted_text string")
    once = ingestion.ingest(files, nothing, nothing.select("content_hash"), options)
    ingestion.store(once, chunks_path, entries_path)
    again = ingestion.ingest(files, spark.read.parquet(entries_path), spark.read.parquet(chunks_path), options)
    both = once.results.withColumn("round", F.lit(1)).unionByName(again.results.withColumn("round", F.lit(2)))
    return both.select("round", "filename", "action", "status", "char_count", "error_message")


@query
def stored_chunks(spark, sf_dir):
    """Chunks that ingestion has stored without getting to their entry: each with its key and text."""
    entries = registry.registry(sources(spark, sf_dir))
    made = retrieval.rebuilt(entries)
    lost = ingestion.orphan_chunks(made, entries.where(F.pmod(F.col("first_id"), F.lit(3)) != 0))
    return lost.select(hashing.chunk_id(F.col("content_hash"), F.col("chunk_index")).alias("id"), "page", F.md5("document").alias("digest"))


# Media, options and office files ------------------------------------------------


@query
def selected_texts(spark, sf_dir):
    """The texts that a notebook's scripts are made of."""
    found = overview.selected_texts(sources(spark, sf_dir))
    return found.select("notebook_id", F.size("texts").alias("n_texts"), F.md5(F.array_join("texts", "\n")).alias("digest"), "total_chars")


@query
def stand_in_scripts(spark, sf_dir):
    """The offline dialogue and slides of each notebook with a text."""
    first = sources(spark, sf_dir).where("length(text) > 0").groupBy("notebook_id").agg(F.array(F.min_by("text", "id")).alias("texts"))
    said = first.select("notebook_id", F.lit("dialogue").alias("part"), F.posexplode(overview.stand_in_dialogue(F.col("notebook_id"), F.col("texts"))).alias("pos", "x"))
    shown = first.select("notebook_id", F.lit("slide").alias("part"), F.posexplode(overview.stand_in_slides(F.col("notebook_id"), F.col("texts"))).alias("pos", "x"))
    said = said.select("notebook_id", "part", "pos", F.col("x.host").alias("kind"), F.col("x.text").alias("text"))
    return said.union(shown.select("notebook_id", "part", "pos", "x.type", F.concat("x.heading", F.lit("|"), F.array_join("x.bullets", "|"), F.lit("|"), "x.narration")))


def script_model():
    """Answers with a fenced script that quotes the request; refuses requests whose length eleven divides, and gives no JSON where seven does."""

    def answer(messages):
        asked = messages[-1]["content"]
        if len(asked) % 11 == 0:
            raise ValueError("too much")
        quoted = asked[-40:].replace("\n", " ").replace('"', "'")
        turns_ = ", ".join(f'{{"host": "B", "text": "{quoted} {k}"}}' for k in range(3))
        slides = f'{{"heading": "{quoted}", "bullets": [" {len(asked)} ", ""]}}'
        return "no script" if len(asked) % 7 == 0 else f'```json\n{{"dialogue": [{turns_}], "slides": [{slides}]}}\n```'

    return answer


@query
def script_requests(spark, sf_dir):
    """What models are asked for each notebook's dialogue and slides, every second with a topic."""
    chosen = overview.selected_texts(sources(spark, sf_dir))
    topic = F.when(F.length("notebook_id") % 2 == 0, F.col("notebook_id"))
    asked = [overview.script_messages(F.col("texts"), F.col("total_chars"), kind, topic) for kind in ("dialogue", "slides")]
    return chosen.select("notebook_id", *(F.md5(generate.messages_key(x)).alias(kind) for kind, x in zip(("dialogue", "slides"), asked)))


@query
def scripts_made(spark, sf_dir):
    """Dialogues and slides of notebooks from a model that fails for some and gives nonsense for others."""
    rows = sources(spark, sf_dir)
    said = overview.scripted(rows, "dialogue", generate.guarded(script_model)).select("notebook_id", F.lit("dialogue").alias("part"), "error", F.expr("transform(script, x -> concat(x.host, ' ', x.text))").alias("script"))
    shown = overview.scripted(rows, "slides", generate.guarded(script_model)).select("notebook_id", F.lit("slides").alias("part"), "error", F.expr("transform(script, x -> concat(x.type, ' ', x.heading, ' ', array_join(x.bullets, '|'), ' ', x.narration))").alias("script"))
    return said.unionByName(shown).select("notebook_id", "part", "error", F.size("script").alias("n"), F.md5(F.array_join("script", "\n")).alias("digest"))


@query
def summaries_kept(spark, sf_dir):
    """Summaries of notebooks: kept where the signature is still that of the sources, else made anew by the offline model."""
    rows = sources(spark, sf_dir)
    now = hashing.content_signatures(rows)
    number = F.coalesce(F.expr("try_cast(substring(notebook_id, 4) as int)"), F.lit(1))
    held = now.select("notebook_id", F.when(number % 2 == 0, F.lit("old")).alias("summary"), F.when(number % 3 == 0, '["q"]').alias("suggested_questions"), F.when(number % 4 == 0, F.col("signature")).otherwise("stale").alias("content_signature"))
    made = overview.summaries(held, now, rows)
    return made.select("notebook_id", "summary", F.size("suggested_questions").alias("n_questions"), "content_signature", "skipped")


@query
def appended_rows(spark, sf_dir):
    """Odd events as rows to append, in the order of time, to a table of the even ones: their ids go on from the largest there."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return registry.appended(events.where("id % 2 = 0"), events.where("id % 2 = 1")).select("id", "created_at")


@query
def audio_outcomes(spark, sf_dir):
    """Users' events as utterances of an audio job, of which one in fifty is made."""
    return overview.media_outcome(table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50 == 0).alias("ok")), "user_id")


@query
def audio_verdicts(spark, sf_dir):
    """Events as recordings of some size and length."""
    error = overview.audio_verdict(F.col("event_id") * 7919 % 20_000_000, F.col("event_id") % 90)
    return table(spark, sf_dir, "events").select("event_id", error.alias("error"))


@query
def audible_slides(spark, sf_dir):
    """Users' events as slides: whether any has narration."""
    seconds = F.when((F.col("user_id") % 3 != 0) & (F.col("event_type") == "view"), F.col("value"))
    return overview.audible(table(spark, sf_dir, "events").select("user_id", seconds.alias("audio_seconds")), "user_id")


@query
def slide_manifest(spark, sf_dir):
    """Users' events as slides, every fourth without narration."""
    seconds = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 97 / F.lit(8.0))
    slides = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.concat("event_type", F.lit(".png")).alias("image"), seconds.alias("audio_seconds"))
    return overview.manifest(slides, "user_id")


@query
def option_values(spark, sf_dir):
    """Settings as an environment gives them, some not set."""
    kinds = F.array(*map(F.lit, [" True ", "1", "no", "", "YES", "12", " 7 ", "x"]))
    raw = F.when(F.col("page_id") % 9 != 0, F.element_at(kinds, (F.col("page_id") % 8 + 1).cast("int")))
    rows = table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"))
    return rows.select("page_id", text.as_bool(F.col("raw")).alias("flag"), text.as_int(F.col("raw"), 5).alias("number"), text.redact_secret(F.col("raw")).alias("shown"))


@query
def error_classes(spark, sf_dir):
    """Errors of a provider: their status, and whether to try again."""
    kinds = F.array(*map(F.lit, ["HTTP 429 Too Many Requests", "Read timed out", "Connection reset", "HTTP 401", "403 Forbidden", "TIMEOUT", "broken"]))
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("message"))
    return rows.select("event_id", text.error_status(F.col("message")).alias("status"), text.retryable(F.col("message")).alias("retryable"))


@query
def account_rules(spark, sf_dir):
    """Names and passwords of all lengths."""
    name, password = F.repeat(F.lit("x"), (F.col("c_custkey") % 140).cast("int")), F.repeat(F.lit("é"), (F.col("c_custkey") % 300).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", admin.valid_name(name).alias("name_ok"), admin.valid_password(password).alias("password_ok"))


@query
def image_fit(spark, sf_dir):
    """Parts as images of all shapes."""
    size = files.fitted_size((F.col("p_partkey") * 37 % 5000 + 1).cast("int"), (F.col("p_partkey") * 91 % 4000 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query
def pdf_pages(spark, sf_dir):
    """Documents as PDF of forty lines a page, a fifth of them cut off: the pages as rows."""
    rows = sources(spark, sf_dir).select(F.col("id").alias("doc_id"), fixtures.printer()(F.coalesce("text", F.lit("")), F.col("id")).alias("content"))
    return pdf.page_rows(rows).select("doc_id", "page", F.md5("text").alias("digest"), "error")


@query
def pdf_texts(spark, sf_dir):
    """The same through the parser of files: whole texts and numbers of pages."""
    rows = sources(spark, sf_dir).select(F.col("id").alias("doc_id"), fixtures.printer()(F.coalesce("text", F.lit("")), F.col("id")).alias("content"))
    return rows.select("doc_id", files.parser()(F.col("content"), F.lit("pdf")).alias("x")).select("doc_id", F.md5("x.text").alias("digest"), "x.page_count", "x.error")


@query
def image_rows(spark, sf_dir):
    """Documents as files with an image for each line: the images as rows, with their place in the file."""
    rows = sources(spark, sf_dir).select(F.col("id").alias("doc_id"), fixtures.packer()(F.coalesce("text", F.lit("")), F.lit("images")).alias("content"), F.lit("docx").alias("content_type"))
    return images.image_rows(rows).select("doc_id", "image_idx", F.md5("image").alias("digest"))


@query
def image_row_texts(spark, sf_dir):
    """The same through the offline text recogniser, image by image, every third blank: a text for each file."""
    rows = sources(spark, sf_dir).select(F.col("id").alias("doc_id"), fixtures.packer()(F.coalesce("text", F.lit("")), F.lit("images")).alias("content"), F.lit("docx").alias("content_type"))
    said = F.when(F.col("image_idx") % 3 != 2, generate.image_text(F.col("image"))).otherwise("")
    return images.texts_of(images.image_rows(rows).withColumn("text", said), "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query
def image_sizes(spark, sf_dir):
    """Parts as grey images of all shapes: what their bytes tell, and the images fitted to sixteen pixels."""
    key = F.col("p_partkey")
    made = fixtures.shaded((key * 37 % 50 + 1).cast("int"), (key * 91 % 40 + 1).cast("int"), key.cast("int"))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", made.alias("image"))
    rows = rows.select("p_partkey", images.described("image").alias("x"), images.fitted(16)("image").alias("image"))
    rows = rows.select("p_partkey", "x", images.described("image").alias("y"), images.pixels("image").alias("p"))
    return rows.select("p_partkey", "x.format", "x.width", "x.height", F.col("y.width").alias("to_width"), F.col("y.height").alias("to_height"), F.md5(F.array_join("p", ",")).alias("digest"))


@query
def speech_inputs(spark, sf_dir):
    """Events as recordings of all rates, some too long, some too large, some broken: what the recogniser gets."""
    k, rates = F.from_json("props", "k int")["k"], F.array(*map(F.lit, [8000, 11025, 16000, 22050, 44100, 48000]))
    rate = F.element_at(rates, (F.col("event_id") % 6 + 1).cast("int"))
    content = F.when(k % 17 == 0, F.lit("not a recording").cast("binary")).otherwise(fixtures.toned(k * 40 + 1, rate, (F.col("event_id") % 2 + 1).cast("int")))
    rows = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "props"))
    rows = rows.select("event_id", F.concat("event_type", F.lit(".wav")).alias("filename"), content.alias("content"))
    made = audio.prepared(rows, max_bytes=12_000, max_ms=250)
    return made.select("event_id", "duration_ms", F.col("rate").alias("from_rate"), (F.octet_length("pcm") / 2).cast("int").alias("n_samples"), "error")


@query
def data_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(files.data_url(F.col("html").cast("binary"), "text/html")).alias("digest"))


@query
def ocr_gate(spark, sf_dir):
    """Documents as files of four types, half of them with little text."""
    kind = F.element_at(F.array(*map(F.lit, ["pdf", "docx", "pptx", "txt"])), (F.col("id") % 4 + 1).cast("int"))
    little = F.when(F.col("id") % 8 < 4, "  few words ").otherwise(F.col("text"))
    return sources(spark, sf_dir).select(F.col("id").alias("doc_id"), files.needs_ocr(little, kind, F.col("id") % 3).alias("needs_ocr"))


@query
def image_texts(spark, sf_dir):
    """Texts of a file's images, the second of them blank."""
    joined = files.joined_image_texts(F.array("text", F.lit(""), "role"), "Image")
    return turns(spark, sf_dir).select("conv_id", "turn", F.md5(joined).alias("digest"))


def moody_model():
    """Refuses numbers that seven divides, and is overloaded whenever it first meets one that five divides."""
    met = set()

    def run(asked):
        event, k = map(int, asked.split(":"))
        if k % 7 == 0:
            raise ValueError(f"refused {k}")
        if k % 5 == 0 and event not in met:
            met.add(event)
            raise TimeoutError("read timed out")
        if k % 11 == 0:
            raise RuntimeError("HTTP 429")
        return f"said {k}"

    return run


@query
def guarded_models(spark, sf_dir):
    """Events through a model that fails by row; transient failures are tried again, and no row fails another."""
    k = F.from_json("props", "k bigint")["k"]
    asked = F.when(F.col("event_type") != "view", F.concat_ws(":", F.col("event_id").cast("string"), k.cast("string")))
    return table(spark, sf_dir, "events").select("event_id", generate.guarded(moody_model)(asked).alias("x")).select("event_id", "x.*")


@query
def sse_tokens(spark, sf_dir):
    """What a reader of a stream of events puts together, a comment between two frames."""
    frames = F.concat(text.sse_frame(F.struct(F.col("text").alias("token"))), F.lit(": ping\n\n"), text.sse_frame(F.struct(F.col("role").alias("token"))))
    return turns(spark, sf_dir).select("conv_id", "turn", F.md5(text.sse_text(frames)).alias("digest"))


@query
def message_sources(spark, sf_dir):
    """Sources of stored messages: some, none, broken."""
    cited = F.to_json(F.array(F.struct(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("filename"), F.col("turn").cast("int").alias("page"))))
    found = chat.parsed_sources(F.when(F.col("conv_id") % 3 == 0, cited).when(F.col("conv_id") % 3 == 1, "[{broken"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(found).alias("n"), F.array_join(found["filename"], ",").alias("filenames"), F.try_element_at(found, F.lit(1))["page"].alias("page"))


@query
def office_texts(spark, sf_dir):
    """Documents as office files, read back: odd ones with a paragraph for each line, even ones with the first line on a slide of its own."""
    kind = F.when(F.col("id") % 2 == 1, "docx").otherwise("pptx")
    rows = sources(spark, sf_dir).select(F.col("id").alias("doc_id"), fixtures.packer()(F.coalesce("text", F.lit("")), kind).alias("content"), kind.alias("kind"))
    rows = rows.select("doc_id", "kind", files.magic_ok(F.col("content"), F.col("kind")).alias("magic_ok"), files.parser()(F.col("content"), F.col("kind")).alias("x"))
    return rows.select("doc_id", "kind", "magic_ok", F.md5("x.text").alias("digest"), F.size("x.images").alias("n_images"), "x.error")
