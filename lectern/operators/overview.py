"""Summaries, dialogues and slides of notebooks, and the manifests of their media."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import generate, scripts
from ..functions.text import length_request
from .context import within_budget

# Prompts and the offline scripts that results depend on.
SUMMARY_PROMPT = (
    "You are a helpful assistant that summarizes documents. Given the source texts, produce a concise summary (max 150 words) and 5 suggested questions a user might ask. "
    'Respond as JSON: {"summary": "...", "suggested_questions": ["q1", ...]}'
)
SUMMARY_REQUEST = "Summarize the following source texts and suggest 5 questions:\n\n"
DIALOGUE_PROMPT = (
    "You are a creative assistant that produces engaging two-host podcast dialogues. Given source texts, write a natural conversation between Ava and Andrew that summarizes and discusses the key points. ",
    "The hosts should alternate turns, reference the sources naturally, and keep it engaging. Ava should introduce herself as Ava, and Andrew should introduce himself as Andrew. "
    "Never use generic labels like 'Host A' or 'Host B' — always use their real names. "
    'IMPORTANT: In the JSON, use "host": "A" for Ava and "host": "B" for Andrew. Respond as JSON: {"dialogue": [{"host": "A", "text": "..."}, {"host": "B", "text": "..."}, ...]}',
)
SLIDES_PROMPT = (
    "You are an expert educator creating a narrated video presentation. Given source texts, produce a slide-by-slide script with narration. \n\nRULES:\n"
    "- Generate exactly 5-8 slides (title + 4-7 content slides + summary).\n"
    "- Each slide has a short heading (max 8 words) and 2-3 very short bullet points (max 6 words each).\n"
    "- Bullets are visual anchors only — the narration carries the depth.\n"
    "- Each slide has a narration: 2-4 conversational sentences (max 60 words) that explain, connect, and elaborate. Do NOT just read the bullets aloud. Use analogies, transitions, and an enthusiastic expert tone.\n"
    "- The title slide narration should introduce the topic enthusiastically.\n"
    "- The summary slide narration should recap key takeaways.\n",
    'Respond as JSON: {"slides": [{"type": "title", "heading": "Short Title", "bullets": ["Brief subtitle"], "narration": "Welcome! Today we are going to explore..."}, '
    '{"type": "content", "heading": "Key Concept", "bullets": ["Point 1", "Point 2"], "narration": "Let me explain this in more detail..."}, '
    '{"type": "summary", "heading": "Key Takeaways", "bullets": ["Takeaway 1", "Takeaway 2"], "narration": "To wrap up, here is what we covered..."}...]}',
)
REQUESTS = {
    "dialogue": (DIALOGUE_PROMPT, "Write a two-host podcast dialogue based on these source texts:\n\n", "Focus the discussion on: "),
    "slides": (SLIDES_PROMPT, "Create a narrated video presentation based on these source texts:\n\n", "Focus the presentation on: "),
}
NO_SOURCES = "No sources have been uploaded yet."
DIALOGUE = [
    "Welcome to the audio overview! Today we're discussing the key points from your sources. [{}]",
    "That's right! The documents cover some interesting topics. Let me start with the main themes.",
    "Based on the sources, the primary focus seems to be on the concepts and relationships described in the text.",
    "Exactly. And there are several important details worth highlighting for our listeners.",
    "Let's wrap up by summarizing the key takeaways. Thanks for listening!",
    "Thank you! We hope this overview was helpful. See you next time!",
]
SLIDES = [
    ("title", "Overview of Your Sources [{}]", ["A summary of key topics"],
     "Welcome! Today we are going to explore the key topics from your uploaded documents. I will walk you through the main concepts and findings, explaining each one in a way that is easy to understand."),
    ("content", "Key Concepts", ["Important themes", "Core ideas"],
     "Let us start with the key concepts. The documents cover several important topics and themes. Each source provides unique insights into the subject matter, and together they paint a comprehensive picture."),
    ("content", "Main Findings", ["Primary focus", "Supporting details"],
     "Now let us look at the main findings. The primary focus is on the concepts and relationships described in the text. There are several important details worth highlighting that connect these ideas together."),
    ("content", "Practical Applications", ["Real-world use", "Key benefits"],
     "How does this apply in practice? The concepts we have discussed have real-world applications that make them valuable. Understanding these connections helps you see why these topics matter."),
    ("summary", "Key Takeaways", ["Main themes", "What to remember"],
     "To wrap up, we have covered the main themes and supporting details from your sources. The key takeaways include the core concepts and their practical significance. Thank you for watching!"),
]


def selected_texts(texts: DataFrame, max_chars: int = 30_000) -> DataFrame:
    """The budgeted texts of each notebook in order, as one array bounded by the budget and the first text."""
    chosen = within_budget(texts, max_chars).join(texts.select("notebook_id", "id", "text"), ["notebook_id", "id"])
    return chosen.groupBy("notebook_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]).alias("texts"), F.sum("chars").alias("total_chars"))


def summaries(notebooks: DataFrame, signatures: DataFrame, texts: DataFrame, model: Column | None = None, max_chars: int = 30_000) -> DataFrame:
    """``(notebook_id, summary, suggested_questions, content_signature, skipped)`` of each notebook.

    ``notebooks``: ``notebook_id, summary, suggested_questions, content_signature`` as stored;
    ``signatures``: the present ``notebook_id, signature``. An unchanged signature keeps the stored
    summary. ``model`` is a column over ``messages``; the offline stand-in by default.
    """
    joined = notebooks.join(signatures, "notebook_id", "left").join(selected_texts(texts, max_chars), "notebook_id", "left")
    skipped = F.col("summary").isNotNull() & F.coalesce(F.col("content_signature") == F.col("signature"), F.lit(False))
    request = F.concat(F.lit(SUMMARY_REQUEST), F.array_join("texts", "\n\n"))
    joined = joined.withColumn("messages", generate.prompt(F.lit(SUMMARY_PROMPT), F.lit(""), request, thinking=False))
    made = scripts.summary(model if model is not None else generate.stand_in_answer(F.col("messages")))
    kind = "struct<summary:string,suggested_questions:array<string>>"
    none = F.struct(F.lit(NO_SOURCES).alias("summary"), F.array().cast("array<string>").alias("suggested_questions"))
    kept = F.struct("summary", F.coalesce(F.from_json("suggested_questions", "array<string>"), F.array().cast("array<string>")).alias("suggested_questions"))
    out = F.when(skipped, kept.cast(kind)).when(F.col("texts").isNull(), none.cast(kind)).otherwise(made.cast(kind))
    return joined.select("notebook_id", out.alias("_o"), F.col("signature").alias("content_signature"), skipped.alias("skipped")).select("notebook_id", "_o.*", "content_signature", "skipped")


def script_messages(texts: Column, chars: Column, kind: str, topic: Column | None = None, least: int = 60, most: int = 480) -> Column:
    """What a model is asked for a notebook's dialogue or slides: the length by its characters, a topic if there is one, the texts."""
    (before, after), request, focus = REQUESTS[kind]
    system = F.concat(F.lit(before), length_request(chars, kind, least, most), F.lit(after))
    asked = F.concat(F.lit(request), F.array_join(texts, "\n\n"))
    if topic is not None:
        asked = F.when(F.coalesce(topic, F.lit("")) != "", F.concat(F.lit(focus), topic, F.lit("\n\n"), asked)).otherwise(asked)
    return generate.prompt(system, F.lit(""), asked, thinking=False)


def scripted(texts: DataFrame, kind: str, model: Callable[[Column], Column], topic: Column | None = None, max_chars: int = 30_000) -> DataFrame:
    """``(notebook_id, script, error)``: each notebook's dialogue, its hosts alternating, or slides, from a model that fails by row (``generate.guarded``).

    A model that fails leaves an empty script and its error; what cannot be parsed is an empty script without one. Notebooks without a text have no row.
    """
    chosen = selected_texts(texts, max_chars).withColumn("_said", model(script_messages(F.col("texts"), F.col("total_chars"), kind, topic)))
    parsed = scripts.alternated(scripts.dialogue(F.col("_said.value"))) if kind == "dialogue" else scripts.slides(F.col("_said.value"))
    empty = F.array().cast("array<struct<host:string,text:string>>" if kind == "dialogue" else scripts.SLIDES)
    return chosen.select("notebook_id", F.coalesce(F.when(F.col("_said.ok"), parsed), empty).alias("script"), F.col("_said.error").alias("error"))


def stored_questions(questions: Column) -> Column:
    """Questions as they are stored: JSON, null if there are none."""
    return F.when(F.size(questions) > 0, F.to_json(questions))


def _mark(notebook: Column, texts: Column) -> Column:
    return generate.digest8(F.concat(notebook.cast("string"), F.lit(":"), F.substring(F.element_at(texts, 1), 1, 50)))


def _marked(template: str, mark: Column) -> Column:
    before, found, after = template.partition("{}")
    return F.concat(F.lit(before), mark, F.lit(after)) if found else F.lit(template)


def stand_in_dialogue(notebook: Column, texts: Column) -> Column:
    """The offline dialogue of a notebook; empty without texts."""
    turns = F.array(*(F.struct(F.lit("AB"[k % 2]).alias("host"), _marked(t, _mark(notebook, texts)).alias("text")) for k, t in enumerate(DIALOGUE)))
    return F.when(F.size(texts) > 0, turns).otherwise(F.array().cast("array<struct<host:string,text:string>>"))


def stand_in_slides(notebook: Column, texts: Column) -> Column:
    """The offline slides of a notebook; empty without texts."""
    made = F.array(
        *(
            F.struct(F.lit(kind).alias("type"), _marked(heading, _mark(notebook, texts)).alias("heading"), F.array(*map(F.lit, bullets)).alias("bullets"), F.lit(said).alias("narration"))
            for kind, heading, bullets, said in SLIDES
        )
    )
    return F.when(F.size(texts) > 0, made).otherwise(F.array().cast(scripts.SLIDES))


def slide_seconds(audio_seconds: Column) -> Column:
    """How long a slide shows: its narration and half a second, else five seconds."""
    return F.round(F.coalesce(audio_seconds + 0.5, F.lit(5.0)), 1)


def media_outcome(utterances: DataFrame, key: str = "notebook_id") -> DataFrame:
    """``(key, n_ok, status)`` from rows with ``ok``: utterances that fail are left out; none at all fails the job."""
    counted = utterances.groupBy(key).agg(F.sum(F.col("ok").cast("int")).alias("n_ok"))
    return counted.withColumn("status", F.when(F.col("n_ok") > 0, "ready").otherwise("failed"))


def audible(slides: DataFrame, key: str = "notebook_id") -> DataFrame:
    """``(key, n_slides, any_audio)``: whether a video has narration at all, for without any it needs no sound."""
    return slides.groupBy(key).agg(F.count("*").alias("n_slides"), F.bool_or(F.col("audio_seconds").isNotNull()).alias("any_audio"))


def manifest(slides: DataFrame, key: str = "notebook_id") -> DataFrame:
    """Files and durations of a video in order: ``key, pos, image, audio_seconds`` to ``key, pos, image, duration``."""
    return slides.select(key, "pos", "image", slide_seconds(F.col("audio_seconds")).alias("duration"))


def audio_verdict(size: Column, seconds: Column, max_mb: int = 10, max_seconds: int = 60) -> Column:
    """Error of a recording that is too large or too long; null if it may be recognised."""
    return F.when(size > max_mb * 1024 * 1024, F.lit(f"Audio upload exceeds {max_mb} MB limit.")).when(seconds > max_seconds, F.lit(f"Audio exceeds {max_seconds}s recording limit."))
