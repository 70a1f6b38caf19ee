"""Questions to answers over many notebooks at once, and chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import generate
from ..functions.guard import NO_INFORMATION, NOT_FULLY_VERIFIED, NOT_VERIFIED, OUT_OF_SCOPE, groundedness, meaningful_words, passes_phrases, word_runs


def in_scope(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """``questions`` with ``in_scope``: a meaningful word of theirs is in a text of their notebook.

    ``questions``: ``question_id, notebook_id, question``; ``texts``: ``notebook_id, text``. Words
    are matched as rows, so a notebook's vocabulary is in no single row or task. It is made distinct where the
    texts lie, so neither texts nor repeats of words are shuffled or sorted.
    """
    asked = questions.where(passes_phrases(F.col("question"))).select("question_id", "notebook_id", F.explode(meaningful_words(F.col("question"))).alias("word"))
    wanted = asked.select("notebook_id", "word").distinct()
    # few asked words are broadcast, and Spark filters by them before it makes words distinct; many meet the distinct ones
    vocabulary = texts.select("notebook_id", F.explode(word_runs(F.col("text"))).alias("word")).distinct().join(wanted, ["notebook_id", "word"], "left_semi")
    hit = asked.join(vocabulary, ["notebook_id", "word"], "left_semi").select("question_id").distinct().withColumn("in_scope", F.lit(True))
    return questions.join(hit, "question_id", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def answers(questions: DataFrame, contexts: DataFrame, model: Column | None = None) -> DataFrame:
    """Answer each question: a refusal out of scope, a fixed answer without context, else the model's, with a note if ungrounded.

    ``questions`` has ``in_scope``; ``contexts``: ``question_id, context``. ``model`` is a column over
    ``messages``; the offline stand-in by default.
    """
    joined = questions.join(contexts, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    joined = joined.withColumn("messages", generate.prompt(F.lit(generate.SYSTEM_PROMPT), F.col("context"), F.col("question")))
    joined = joined.withColumn("_said", model if model is not None else generate.stand_in_answer(F.col("messages")))
    checked = groundedness(F.col("_said"), F.col("context"))
    answer = F.when(~F.col("in_scope"), OUT_OF_SCOPE).when(F.col("context") == "", NO_INFORMATION).otherwise(checked["result"])
    return joined.withColumn("answer", answer).drop("_said")


def as_messages(answered: DataFrame) -> DataFrame:
    """The two chat rows of each answer, the question first; no sources are null."""
    sources = F.when(F.size("sources") > 0, F.to_json("sources")) if "sources" in answered.columns else F.lit(None).cast("string")
    row = lambda seq, role, text, cited: F.struct(F.lit(seq).alias("seq"), F.lit(role).alias("role"), text.alias("content"), cited.alias("sources_json"))
    pair = F.array(row(0, "user", F.col("question"), F.lit(None).cast("string")), row(1, "assistant", F.col("answer"), sources))
    return answered.select("question_id", "notebook_id", F.inline(pair))


def history(messages: DataFrame, notebook: str = "notebook_id", order: tuple[str, ...] = ("created_at", "id"), limit: int = 100) -> DataFrame:
    """The first ``limit`` messages of each notebook; the limit is pushed below the shuffle."""
    own = Window.partitionBy(notebook).orderBy(*order)
    return messages.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= limit).drop("_n")


def parsed_sources(json: Column) -> Column:
    kind = "array<struct<filename:string,page:int>>"
    return F.coalesce(F.from_json(json, kind), F.array().cast(kind))


def pairs(messages: DataFrame, notebook: str = "notebook_id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Each user message with the assistant message right after it."""
    own = Window.partitionBy(notebook).orderBy(*order)
    following = messages.withColumn("next_role", F.lead("role").over(own)).withColumn("answer", F.lead("content").over(own))
    return following.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).drop("role", "next_role")


def stream_frames(answered: DataFrame) -> DataFrame:
    """``(question_id, seq, payload)``: the tokens of each answer and the closing frame.

    An answer streams by its words, a note after it as a token of its own; one without
    a model behind it (``in_scope`` false, or an empty ``context``) is one token. The closing
    frame tells ``sources`` and ``latency_ms`` as far as ``answered`` has them.
    """
    answer = F.col("answer")
    note = F.lit("")
    for text in (NOT_FULLY_VERIFIED, NOT_VERIFIED):
        note = F.when(answer.endswith(text), text).otherwise(note)
    said = F.left(answer, (F.length(answer) - F.length(note)).cast("int"))
    words = F.concat(generate.answer_tokens(said), F.when(note != "", F.array(note)).otherwise(F.array().cast("array<string>")))
    fixed = F.lit(False)
    if "in_scope" in answered.columns:
        fixed = fixed | ~F.col("in_scope")
    if "context" in answered.columns:
        fixed = fixed | (F.col("context") == "")
    tokens = F.transform(F.when(fixed, F.array(answer)).otherwise(words), lambda w: F.to_json(F.struct(w.alias("token"))))
    told = [F.coalesce(F.col("sources"), F.array().cast(answered.schema["sources"].dataType)).alias("sources")] if "sources" in answered.columns else []
    told += [F.col("latency_ms")] if "latency_ms" in answered.columns else []
    closing = F.to_json(F.struct(*told, F.lit(True).alias("done")), {"ignoreNullFields": "false"})
    return answered.select("question_id", F.posexplode(F.array_append(tokens, closing)).alias("seq", "payload"))


def error_frame(error: Column) -> Column:
    return F.to_json(F.struct(error.alias("error"), F.lit(True).alias("done")))
