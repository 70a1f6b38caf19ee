"""Generated JSON to typed rows: summaries, dialogues and slides.

JSON is read leniently as a variant. Where text does not parse, a summary falls back
to the raw text and a dialogue to what its markers show. Values that are no strings
are shown as JSON shows them (``true``, ``1``); null elements are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip, strip_fences

MAX_QUESTIONS = 5
#: Labels of the first host.
FIRST_HOST = ["a", "host_a", "host a", "1", "first", "left", "ava"]
#: How a turn begins in JSON that does not parse, and how its text ends.
MARKER = r'(?Uds)"host"\s*:\s*"([^"]+)"\s*,\s*"text"\s*:\s*"'
TAIL = r'(?Ud)\s*"\s*\}[\s,\]]*\z'


def _field(json: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(json), path, kind)


def summary(raw: Column) -> Column:
    """Struct ``(summary, suggested_questions)``; null if the JSON is no object."""
    clean = strip_fences(raw)
    parsed = F.try_parse_json(clean)
    questions = F.slice(F.coalesce(F.try_variant_get(parsed, "$.suggested_questions", "array<string>"), F.array().cast("array<string>")), 1, MAX_QUESTIONS)
    none = F.array().cast("array<string>")
    out = lambda a, b: F.struct(a.alias("summary"), b.alias("suggested_questions"))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", out(F.lit(""), none))
        .when(parsed.isNull(), out(raw, none))
        .when(F.schema_of_variant(parsed).startswith("OBJECT"), out(F.coalesce(F.try_variant_get(parsed, "$.summary", "string"), F.lit("")), questions))
    )


def host(label: Column) -> Column:
    return F.when(F.lower(py_strip(label)).isin(*FIRST_HOST), "A").otherwise("B")


def dialogue(raw: Column) -> Column:
    """Array of ``(host, text)``: blank texts dropped, hosts normalised; of broken JSON, what its markers show."""
    clean = strip_fences(raw, greedy=True)
    parsed = F.try_parse_json(clean)
    items = F.try_variant_get(parsed, "$.dialogue", "array<variant>")
    turn = lambda h, t: F.struct(host(h).alias("host"), py_strip(t).alias("text"))
    of_json = F.transform(
        F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")),
        lambda x: turn(F.coalesce(F.try_variant_get(x, "$.host", "string"), F.lit("A")), F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))),
    )
    labels = F.regexp_extract_all(clean, F.lit(MARKER), 1)
    texts = F.slice(F.split(clean, MARKER), 2, 1 << 30)
    of_markers = F.transform(F.arrays_zip(labels.alias("h"), texts.alias("t")), lambda x: turn(x["h"], F.regexp_replace(x["t"], TAIL, "")))
    found = F.when(parsed.isNotNull(), of_json).otherwise(of_markers)
    return F.coalesce(F.filter(found, lambda x: x["text"] != ""), F.array().cast("array<struct<host:string,text:string>>"))


def alternated(turns: Column) -> Column:
    """Hosts A and B by position, whatever the labels say."""
    return F.transform(turns, lambda x, k: F.struct(host_at(k).alias("host"), x["text"].alias("text")))


def host_at(position: Column) -> Column:
    """The host of a turn by its position from 0, for turns that are rows."""
    return F.when(position % 2 == 0, "A").otherwise("B")


SLIDES = "array<struct<type:string,heading:string,bullets:array<string>,narration:string>>"


def slides(raw: Column) -> Column:
    """Array of ``(type, heading, bullets, narration)``; slides without a heading are dropped."""
    items = _field(strip_fences(raw, greedy=True), "$.slides", "array<variant>")
    text = lambda x, path, default: F.coalesce(F.try_variant_get(x, path, "string"), F.lit(default))

    def slide(x: Column) -> Column:
        heading, narration = py_strip(text(x, "$.heading", "")), py_strip(text(x, "$.narration", ""))
        bullets = F.coalesce(F.try_variant_get(x, "$.bullets", "array<string>"), F.array().cast("array<string>"))
        return F.struct(
            text(x, "$.type", "content").alias("type"), heading.alias("heading"),
            F.filter(F.transform(bullets, py_strip), lambda b: b != "").alias("bullets"), F.when(narration != "", narration).otherwise(heading).alias("narration"),
        )

    made = F.transform(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), slide)
    return F.coalesce(F.filter(made, lambda x: x["heading"] != ""), F.array().cast(SLIDES))
