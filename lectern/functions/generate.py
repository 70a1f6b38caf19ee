"""Prompts and the offline stand-ins for chat, image text and speech models; plugs for real ones."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prompts and canned answers that results depend on.
SYSTEM_PROMPT = (
    "You are a helpful assistant that answers questions based on the provided sources. Always cite sources when possible. "
    "If the answer is not in the sources, say you don't have enough information. Keep answers concise."
)
QUESTION_TEMPLATE = ("Use the following context to answer the question. If the answer is not in the context, say you don't know.\n\nContext:\n", "\n\nQuestion: ")
OCR_KINDS = {
    "text": ("[mock OCR text recognition page ", "] The document contains searchable content extracted via mock OCR."),
    "formula": ("[mock OCR formula recognition ", "] E = mc^2 (mock formula)"),
    "table": ("[mock OCR table recognition ", "] | Col A | Col B |\n| 1 | 2 |"),
}
HEARD = "] What databases are mentioned in the sources?"


def digest8(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 8)


def prompt(system: Column, context: Column, question: Column, thinking: bool = True) -> Column:
    """Array of ``(role, content)``: the system message and the question, with its context if there is one."""
    asked = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(QUESTION_TEMPLATE[0]), context, F.lit(QUESTION_TEMPLATE[1]), question)).otherwise(question)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.concat(F.lit("<|think|>"), system) if thinking else system), message("user", asked))


def messages_key(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


def last_user_content(messages: Column) -> Column:
    own = F.filter(messages, lambda m: m["role"] == "user")
    return F.coalesce(F.try_element_at(own, F.lit(-1))["content"], F.lit(""))


def stand_in_answer(messages: Column) -> Column:
    """The offline chat model's answer."""
    return F.concat(
        F.lit("[mock answer "), digest8(messages_key(messages)), F.lit("] Based on the provided sources, here is a response to: "), F.substring(last_user_content(messages), 1, 60), F.lit(".")
    )


def plain_stand_in_answer(messages: list) -> str:
    """The same for one list of messages, for plugs that call it value by value."""
    key = "|".join(f"{m['role']}:{m['content']}" for m in messages)
    asked = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
    return f"[mock answer {hashlib.sha256(key.encode()).hexdigest()[:8]}] Based on the provided sources, here is a response to: {asked[:60]}."


def answer_tokens(answer: Column) -> Column:
    """The words of an answer, each with a space, as a model would stream them."""
    words = F.filter(F.split(answer, r"(?U)\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.concat(w, F.lit(" ")))


def image_text(content: Column, kind: str = "text") -> Column:
    """The offline text recogniser's output for an image's bytes."""
    before, after = OCR_KINDS.get(kind, ("[mock OCR ", "]"))
    return F.concat(F.lit(before), digest8(content), F.lit(after))


def speech_text(content: Column) -> Column:
    """Struct of the offline speech recogniser's result for an audio file's bytes."""
    heard = F.concat(F.lit("[mock transcription "), digest8(content), F.lit(HEARD))
    return F.struct(heard.alias("text"), F.lit("en").alias("language"), F.lit(4200).alias("duration_ms"), F.lit("mock").alias("provider"))


def with_retry(call: Callable, attempts: int = 2) -> Callable:
    """``call`` with further attempts after an error worth one: rate limit, time-out, connection."""

    def run(*args: object) -> object:
        for left in reversed(range(attempts)):
            try:
                return call(*args)
            except Exception as error:
                said = str(error).lower()
                if not left or not any(x in said for x in ("429", "timeout", "timed out", "connection")):
                    raise

    return run


def plugged(df: DataFrame, model: Callable[[], Callable[[list], list]], column: str, to: str, kind: str = "string") -> DataFrame:
    """Add ``to``: ``column`` through a model that each worker makes once (chat, image text, speech)."""

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = with_retry(model())
        for values in batches:
            yield pd.Series(run(values.tolist()), index=values.index)

    return df.withColumn(to, apply(F.col(column)))


#: Models that this worker has made, by plug.
_MODELS: dict[str, Callable] = {}
#: What an error says that is worth another attempt.
TRANSIENT = ("429", "timeout", "timed out", "connection")


def guarded(model: Callable[[], Callable], kind: str = "string", attempts: int = 2) -> Callable[[Column], Column]:
    """A column function through a model that never fails its batch: struct ``(ok, value, error, attempts)``.

    A worker makes the model once and keeps it for its later batches and tasks; it is called value by
    value. A rate limit, time-out or lost connection is worth another attempt, up to ``attempts``; any
    other error ends the row at once. A model that cannot be made is an error of every
    row. Null values are not asked: not ok, without error or attempt.
    """
    plug = uuid.uuid4().hex

    def called(run: Callable, value: object) -> tuple:
        for n in range(1, attempts + 1):
            try:
                return True, run(value), None, n
            except Exception as error:
                said = f"{type(error).__name__}: {error}"
                if n == attempts or not any(x in said.lower() for x in TRANSIENT):
                    return False, None, said, n
        return False, None, None, 0

    def unmade(error: Exception) -> Callable:
        def run(value: object) -> None:
            raise type(error)(*error.args)

        return run

    @F.pandas_udf(f"struct<ok:boolean,value:{kind},error:string,attempts:int>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if plug not in _MODELS:
            try:
                _MODELS[plug] = model()
            except Exception as error:
                _MODELS[plug] = unmade(error)
        run = _MODELS[plug]
        for values in batches:
            null = lambda v: v is None or v is pd.NA or (isinstance(v, float) and v != v)
            rows = [(False, None, None, 0) if null(v) else called(run, v) for v in values]
            yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object if c in ("value", "error") else None) for k, c in enumerate(("ok", "value", "error", "attempts"))})

    return apply
