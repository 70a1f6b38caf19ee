"""Text functions as columns. ``(?Ud)`` gives Java's expressions Python's classes and line ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VOICES = {"Ava": "en-US-AvaNeural", "Andrew": "en-US-AndrewNeural", "Emma": "en-US-EmmaNeural", "Ryan": "en-US-RyanNeural"}
DEFAULT_VOICE = "en-US-AvaNeural"
TYPES = {"pdf": ".pdf", "docx": ".docx", "pptx": ".pptx", "txt": ".txt", "md": ".md"}
AVATARS = [f"avatar-{k}.png" for k in range(9)]
SPEAKERS = list(VOICES)


def py_strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?Ud)\A\s+|\s+\z", "")


def strip_fences(raw: Column, greedy: bool = False) -> Column:
    """The inside of a fenced block, stripped; the text itself, stripped, if there is none.

    ``greedy`` takes the last closing fence and also drops an opening fence without an end.
    """
    text = py_strip(raw) if greedy else raw
    pattern = r"(?Uds)```(?:json)?\s*\n?(" + (".*" if greedy else ".*?") + r")\n?```"
    inside = py_strip(F.regexp_extract(text, pattern, 1))
    rest = py_strip(text)
    if greedy:
        cut = F.locate("\n", text)
        rest = F.when(text.startswith("```") & (cut > 0), py_strip(text.substr(cut + 1, F.length(text)))).otherwise(text)
    return F.when(text.rlike(pattern), inside).otherwise(rest)


def final_answer(raw: Column) -> Column:
    """Generated text without its thinking blocks; if nothing else is left, the text itself."""
    clean = py_strip(F.regexp_replace(raw, r"(?Uds)<\|channel\|thought\s*\n?.*?<\|?channel\|>", ""))
    return F.when(F.coalesce(raw, F.lit("")) == "", "").when(clean != "", clean).otherwise(py_strip(raw))


#: Patterns and replacements that turn formatted into spoken text, in this order.
SPOKEN = [
    (r"(?Udi)\[(?:Source\s+\d+(?:\s*,\s*Source\s+\d+)*)\]", ""),
    (r"(?Ud)```[^\n]*\n?", ""),
    (r"(?Ud)`([^`]*)`", "$1"),
    (r"(?Udm)^#{1,6}\s+", ""),
    (r"(?Ud)\*\*(.+?)\*\*", "$1"),
    (r"(?Ud)(?<!\w)__(.+?)__(?!\w)", "$1"),
    (r"(?Ud)(?<!\w)\*(.+?)\*(?!\w)", "$1"),
    (r"(?Ud)\[([^\]]*)\]\([^\)]*\)", "$1"),
    (r"(?Udm)^[\-\*]\s+", ""),
    (r"(?Udm)^[\-\*]{3,}\s*$", ""),
    (r"(?Ud)\s+([.,;:!?)])", "$1"),
    (r"(?Ud)\n{3,}", "\n\n"),
]


#: What a text must hold for each of those patterns to meet anything, any one of these; nothing where it may always.
MARKS = [("[",), ("```",), ("`",), ("#",), ("**",), ("__",), ("*",), ("](",), ("-", "*"), ("-", "*"), (), ("\n\n\n",)]


def spoken(text: Column) -> Column:
    """Formatted text as it should be read aloud; empty for null. A pass whose mark a text lacks is left out."""
    out = F.coalesce(text, F.lit(""))
    for (pattern, replacement), marks in zip(SPOKEN, MARKS, strict=True):
        out = _passed(out, pattern, replacement, marks)
    return py_strip(out)


def _passed(text: Column, pattern: str, replacement: str, marks: tuple[str, ...]) -> Column:
    if not marks:
        return F.regexp_replace(text, pattern, replacement)

    def step(t: Column) -> Column:
        return F.when(reduce(Column.__or__, [t.contains(x) for x in marks]), F.regexp_replace(t, pattern, replacement)).otherwise(t)

    # inside a function of one element, the text so far is named twice and computed once
    return F.element_at(F.transform(F.array(text), step), 1)


def voice_of(speaker: Column) -> Column:
    voices = F.create_map(*(F.lit(x) for pair in VOICES.items() for x in pair))
    return F.coalesce(F.element_at(voices, speaker), F.lit(DEFAULT_VOICE))


def sse_frame(payload: Column) -> Column:
    """A server-sent event with the payload as compact JSON."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def sse_text(frames: Column) -> Column:
    """The tokens of a stream of server-sent events, joined; lines that are no data are skipped."""
    lines = F.filter(F.split(frames, "\n"), lambda x: x.startswith("data: "))
    tokens = F.transform(lines, lambda x: F.get_json_object(F.substring(x, 7, 1 << 30), "$.token"))
    return F.array_join(F.filter(tokens, lambda x: x.isNotNull()), "")


def redact_secret(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", "<set>").otherwise("<unset>")


def redact_url(url: Column) -> Column:
    """The URL with its credentials masked; split at the first ``://`` and the last ``@``."""
    at = F.locate("://", url)
    rest = url.substr(at + 3, F.length(url))
    host = F.element_at(F.split(rest, "@"), -1)
    masked = F.concat(url.substr(F.lit(1), at + 2), F.lit("***@"), host)
    return F.when((at > 0) & rest.contains("@"), masked).otherwise(url)


def as_bool(value: Column, default: bool = False) -> Column:
    return F.lower(py_strip(F.coalesce(value, F.lit(str(default))))).isin("true", "1", "yes")


def as_int(value: Column, default: int) -> Column:
    return F.coalesce(py_strip(value).try_cast("int"), F.lit(default))


def basename(path: Column) -> Column:
    """The last part of a path without a trailing slash; null if it is empty, ``.`` or ``..``."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when(~name.isin("", ".", ".."), name)


def suffix(name: Column) -> Column:
    """The last suffix in lower case, with its dot; empty without one. A leading dot begins no suffix."""
    last = F.lower(F.regexp_extract(name, r"[^./]\.*(\.[^./]+)$", 1))
    return last


def content_type(name: Column) -> Column:
    """The type by suffix; null if there is none or it is not supported."""
    kinds = F.create_map(*(F.lit(x) for kind, ext in TYPES.items() for x in (ext, kind)))
    return F.try_element_at(kinds, suffix(name))


def magic_ok(content: Column, kind: Column) -> Column:
    """Whether the first bytes suit the type; plain text has no zero byte in its first 4096."""
    head = F.hex(F.substring(content, 1, 4))
    plain = ~F.hex(F.substring(content, 1, 4096)).rlike("^(?:..)*?00")
    fits = F.when(kind == "pdf", head == "25504446").when(kind.isin("docx", "pptx"), head == "504B0304").when(kind.isin("txt", "md"), plain)
    return F.coalesce(fits, F.lit(False))


def speech_seconds(chars: Column, least: int = 60, most: int = 480) -> Column:
    """Target length of a script: a second for 150 characters, within limits."""
    return F.least(F.greatest(F.floor(chars / 150), F.lit(least)), F.lit(most)).cast("int")


def speech_words(seconds: Column) -> Column:
    return F.floor(seconds * 2.5).cast("int")


#: What a model is told of the length of a dialogue, and of the narration of slides.
LENGTHS = {"dialogue": ("The dialogue should be about ", " seconds when spoken (~", " words). "), "slides": ("- Total narration across all slides should be about ", " seconds when spoken (~", " words total). ")}


def length_request(chars: Column, kind: str = "dialogue", least: int = 60, most: int = 480) -> Column:
    """What a model is told of the length of its script, by the characters of the sources."""
    seconds = speech_seconds(chars, least, most)
    before, between, after = LENGTHS[kind]
    return F.concat(F.lit(before), seconds.cast("string"), F.lit(between), speech_words(seconds).cast("string"), F.lit(after))


def reply_name(name: Column) -> Column:
    """The name of a reply's file as it is; null if it is blank, names a folder, or has a slash of either kind."""
    return F.when((name != "") & ~name.isin(".", "..") & ~name.contains("/") & ~name.contains("\\"), name)


def latency_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from one time to another, cut towards zero."""
    return ((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("int")


def citation_label(filename: Column, page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(filename, F.lit(" p."), page.cast("string"))).otherwise(filename)


def error_status(message: Column) -> Column:
    """401 or 403 if the message names it."""
    return F.when(message.contains("401"), 401).when(message.contains("403"), 403)


def retryable(message: Column) -> Column:
    """Whether an error is worth another attempt: rate limit, time-out or connection."""
    m = F.lower(message)
    return m.contains("429") | m.contains("timeout") | m.contains("timed out") | m.contains("connection")
