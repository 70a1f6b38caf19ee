"""Markdown to HTML for chat answers, and text wrapping for slides."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The markup that results show.
CLASSES = {"code": "md-code", "pre": "md-code-block", "hr": "md-hr", "h": "md-heading", "blockquote": "md-blockquote", "ul": "md-list", "ol": "md-list"}
EMPHASIS = [(re.compile(r"\*\*(.+?)\*\*"), "strong"), (re.compile(r"(?<!\w)\*(.+?)\*(?!\w)"), "em"), (re.compile(r"(?<!\w)_(.+?)_(?!\w)"), "em")]
CODE = re.compile(r"`([^`]+)`")
LINK = re.compile(r"\[([^\]]*)\]\((https?://[^)]*)\)", re.I)
KINDS = [("hr", re.compile(r"---+\s*$")), ("h", re.compile(r"(#{2,4})\s+(.*)$")), ("blockquote", re.compile(r"\s*> (.*)$")), ("ul", re.compile(r"[-*]\s+(.*)$")), ("ol", re.compile(r"\d+\.\s+(.*)$"))]


def inline(text: str) -> str:
    """Code, emphasis and web links of escaped text."""
    text = CODE.sub(rf'<code class="{CLASSES["code"]}">\1</code>', html.escape(text, quote=False))
    for pattern, tag in EMPHASIS:
        text = pattern.sub(rf"<{tag}>\1</{tag}>", text)
    return LINK.sub(r'<a href="\2" target="_blank" rel="noopener noreferrer">\1</a>', text)


def _lines(text: str) -> Iterator[tuple[str, int, re.Match | str]]:
    """``(kind, block, content)`` of each line; a fence begins a block of code and the next one ends it."""
    fenced, block = False, 0
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced, block = not fenced, block + 1
            if fenced:
                yield "pre", block, ""
        elif fenced:
            yield "pre", block, line
        elif not line.strip():
            block += 1
        else:
            kind, found = next(((k, m) for k, p in KINDS if (m := p.match(line))), ("p", line))
            block += kind in ("hr", "h")
            yield kind, block, found


def render(text: str | None) -> str:
    """HTML of fenced code, rules, headings, quotes, lists and paragraphs; all text is escaped."""
    out = []
    for (kind, _), group in groupby(_lines(text or ""), key=lambda x: x[:2]):
        own = [x for _, _, x in group]
        name = f' class="{CLASSES[kind]}"' if kind in CLASSES else ""
        if kind == "hr":
            out.append(f"<hr{name}>")
        elif kind == "h":
            level = len(own[0][1])
            out.append(f"<h{level}{name}>{inline(own[0][2])}</h{level}>")
        elif kind == "pre":
            body = html.escape("\n".join(own[1:]), quote=False)
            out.append(f"<pre{name}><code>{body}</code></pre>")
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}{name}>" + "".join(f"<li>{inline(m[1])}</li>" for m in own) + f"</{kind}>")
        else:
            out.append(f"<{kind}{name}>" + inline(" ".join(x if isinstance(x, str) else x[1] for x in own)) + f"</{kind}>")
    return "".join(out)


@F.pandas_udf(T.StringType())
def markdown_html(texts: pd.Series) -> pd.Series:
    return texts.map(render)


def wrap(text: str | None, width: int = 40) -> list[str]:
    """Greedy lines of at most ``width`` characters; a longer word stands alone."""
    lines: list[str] = []
    current = ""
    for word in (text or "").split():
        longer = f"{current} {word}".strip()
        if len(longer) <= width or not current:
            current = longer
        else:
            lines.append(current)
            current = word
    return [*lines, current] if current else lines


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrapped(texts: pd.Series) -> pd.Series:
    return texts.map(wrap)
