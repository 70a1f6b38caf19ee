"""Lexical guards: is a question about the sources, and is an answer grounded in its context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# The words, phrases and notes that results depend on.
STOPWORDS = (
    "a an the and or but is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between under over again further then once here there when where why how "
    "all any both each few more most other some such only own same so than too very just also not no nor this that these those i me my we our you your "
    "he him his she her it its they them their what which who whom whose if because while about against up down out off away"
).split()
OFF_TOPIC = ["weather", "sports", "cook", "recipe", "joke", "movie", "song", "video game", "tv show", "celebrity", "gossip", "horoscope", "lottery", "stock market", "crypto price"]
GREETINGS = ["hello", "hi", "hey", "how are you", "good morning", "good evening", "what(?:'s| is) up"]
NOT_VERIFIED = "\n\n*Note: This answer could not be verified against the provided sources. Please verify independently.*"
NOT_FULLY_VERIFIED = "\n\n*Note: This answer could not be fully verified against the provided sources. Please verify independently.*"
OUT_OF_SCOPE = "I can only answer questions related to the sources in this notebook. Please ask a question about the uploaded documents."
NO_INFORMATION = "I don't have enough information from the sources to answer that question."


def word_runs(text: Column) -> Column:
    """The lower-case runs of three or more ASCII letters, repeats and stopwords included; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z]{3,}"), 0)


def meaningful_words(text: Column) -> Column:
    """The distinct lower-case runs of three or more ASCII letters that are no stopwords; empty for null."""
    return F.array_except(F.array_distinct(word_runs(text)), F.array(*map(F.lit, STOPWORDS)))


def passes_phrases(question: Column) -> Column:
    """Neither blank nor a greeting nor off topic; phrases count anywhere, also inside words."""
    q = py_strip(F.lower(F.coalesce(question, F.lit(""))))
    greeting = q.rlike(r"(?U)^\s*(?:" + "|".join(GREETINGS) + r")\b")
    off_topic = q.rlike("|".join(OFF_TOPIC))
    return (q != "") & ~greeting & ~off_topic


def is_in_scope(question: Column, source_words: Column) -> Column:
    """Whether the question shares a meaningful word with ``source_words`` and passes the phrase checks.

    ``source_words`` is the array of a notebook's meaningful words, null or empty without sources.
    """
    return passes_phrases(question) & F.coalesce(F.arrays_overlap(meaningful_words(question), source_words), F.lit(False))


def groundedness(answer: Column, context: Column, threshold: float = 0.5) -> Column:
    """Struct ``(grounded, result)``: the answer, with a note if too few of its words are in the context."""
    said, known = meaningful_words(answer), meaningful_words(context)
    share = F.size(F.array_intersect(said, known)) / F.size(said)
    out = lambda ok, text: F.struct(F.lit(ok).alias("grounded"), text.alias("result"))
    noted = lambda note: out(False, F.concat(answer, F.lit(note)))
    return (
        F.when(F.coalesce(answer, F.lit("")) == "", out(True, answer))
        .when(F.coalesce(context, F.lit("")) == "", noted(NOT_VERIFIED))
        .when(F.size(said) == 0, out(True, answer))
        .when(F.size(known) == 0, noted(NOT_VERIFIED))
        .when(share >= threshold, out(True, answer))
        .otherwise(noted(NOT_FULLY_VERIFIED))
    )
