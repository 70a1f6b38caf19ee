"""Whole questions to answers: scope, retrieval that makes lost collections anew, prompt, model, note, sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunk, embed, generate
from ..functions.guard import NO_INFORMATION, OUT_OF_SCOPE, groundedness
from ..sources.tables import stored
from . import chat, context, retrieval

CHUNKS = "content_hash string, chunk_index int, page int, document string, embedding array<float>"
NO_QUESTION = "Question is required."


@dataclass
class Library:
    """What can be asked: ``sources (id, notebook_id, content_hash, filename)``, the registry's ``entries
    (content_hash, extracted_text)`` and the stored ``chunks``, of which collections may be lost."""

    sources: DataFrame
    entries: DataFrame
    chunks: DataFrame


@dataclass
class Asked:
    """``answers``: a row for each question; ``rebuilt``: chunks of collections that were lost, to be stored."""

    answers: DataFrame
    rebuilt: DataFrame


def embedded(lost: DataFrame, embedding: Callable[[Column], Column]) -> DataFrame:
    """Chunks of lost registry entries, made and embedded anew."""
    made = chunk.dealt(retrieval.rebuilt(lost), F.col("content_hash"))
    return made.withColumn("embedding", embedding(F.col("document"))).select("content_hash", F.col("chunk_index").cast("int"), F.col("page").cast("int"), "document", "embedding")


def ask(
    questions: DataFrame, library: Library, document: Callable[[Column], Column] | None = None, query: Callable[[Column], Column] | None = None,
    model: Callable[[Column], Column] | None = None, metric: str = "l2",
) -> Asked:
    """Answer ``questions (question_id, notebook_id, question)`` over the notebooks they ask.

    Only notebooks with a question in scope are read on: of their contents, collections without
    chunks are made anew from the registry before anything is scored. ``model`` is a column function
    from messages to a struct ``(ok, value, error, ...)``, see ``generate.guarded``; the offline stand-in by
    default. Answers have ``in_scope``, ``context``, ``answer``, ``sources`` (distinct file and page in the
    order of their rank) and ``error``: why a question has no answer, null if it has one. A blank question is such an
    error, a failing model another; neither fails the rest. ``document`` and ``query`` embed texts.
    """
    document, query = document or embed.embedder(), query or embed.embedder(query=True)
    books = questions.select("notebook_id").distinct()
    sources = library.sources.join(books, "notebook_id", "left_semi")
    contents = sources.select("notebook_id", "content_hash").distinct()
    texts = contents.join(library.entries.select("content_hash", F.col("extracted_text").alias("text")), "content_hash")
    asked = stored(chat.in_scope(questions, texts.select("notebook_id", "text")), "asked")
    scoped = asked.where("in_scope")
    own = stored(contents.join(scoped.select("notebook_id").distinct(), "notebook_id", "left_semi"), "own")
    wanted = own.select("content_hash").distinct()
    held = library.chunks.join(wanted, "content_hash", "left_semi")
    rebuilt = stored(embedded(retrieval.missing_collections(own, held, library.entries), document), "rebuilt")
    chunks = held.select(*rebuilt.columns).unionByName(rebuilt)
    vectors = scoped.withColumn("embedding", query(F.col("question")))
    scores = retrieval.scored(chunks.join(own, "content_hash"), vectors, scope="notebook_id", top=retrieval.TOP, metric=metric)
    hits = stored(retrieval.with_provenance(retrieval.merged(scores), chunks, sources), "hits")
    cited = F.struct("rank", "filename", "page")
    of_question = context.citations(hits).groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(cited)), lambda x: F.struct(x["filename"], x["page"].cast("int").alias("page"))).alias("sources"))
    joined = asked.join(context.context_strings(hits), "question_id", "left").join(of_question, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    joined = joined.withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<filename:string,page:int>>")))

    asks = F.col("in_scope") & (F.col("context") != "")
    messages = generate.prompt(F.lit(generate.SYSTEM_PROMPT), F.col("context"), F.col("question"))
    if model is None:
        said = F.struct(F.lit(True).alias("ok"), generate.stand_in_answer(messages).alias("value"), F.lit(None).cast("string").alias("error"))
    else:
        said = model(F.when(asks, messages))
    joined = joined.withColumn("_said", said)
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    failed = F.when(blank, NO_QUESTION).when(asks & ~F.col("_said.ok"), F.col("_said.error"))
    noted = groundedness(F.col("_said.value"), F.col("context"))["result"]
    answer = F.when(failed.isNotNull(), F.lit(None).cast("string")).when(~F.col("in_scope"), OUT_OF_SCOPE).when(F.col("context") == "", NO_INFORMATION).otherwise(noted)
    return Asked(joined.withColumn("answer", answer).withColumn("error", failed).drop("_said"), rebuilt)
