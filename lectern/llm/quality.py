"""Line-first quality rules.

Lines are judged first: a line goes if it has the marks of navigation (entries between
separators, names of a site's pages, a column of short titles), boilerplate or junk, or
runs on like prose without any punctuation that ends a sentence. A document
that loses too much of its text is rejected, as is one that fails the base rules.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, slices, text_or_empty, windows, word_hashes

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Separators between the entries of menus and tables.
SEPARATORS = {b"|", b">", b">>", b"/", b"\\", "»".encode(), "›".encode(), "·".encode(), "•".encode()}
#: Phrases of notices that sites repeat; lower case.
BOILERPLATE = re.compile(
    b"all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|javascript"
    b"|lorem ipsum|sign up for|subscribe to our|click here|powered by"
)
END = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode(), "’".encode(), "。".encode(), "！".encode(), "？".encode())

#: Names of a site's own pages; lower case.
PAGE_NAMES = set(
    b"about account archive blog careers cart checkout contact download downloads events faq forum gallery help home login logout menu news press privacy products"
    b" register search services shop sitemap support terms".split()
)

#: A line of at least so many words of which none ends a sentence fails; shorter ones may be titles.
PROSE_WORDS = 15
#: So many lines on end of so many capitalised words at most are a menu.
MENU_LINES, ENTRY_WORDS = 6, 3
#: Shares of a line's words from which it fails.
MAX_SEPARATORS = 0.2
MAX_PAGE_NAMES = 0.5
MAX_SYMBOL_WORDS = 0.4
MAX_SHOUTED = 0.6
#: Share of a document's words that failing lines may hold.
MAX_LOST = 0.5


def line_fails(line: bytes) -> bool:
    """Whether a line with a word in it fails the punctuation, navigation, boilerplate or junk rules."""
    words = line.split()
    n = len(words)
    if sum(map(SEPARATORS.__contains__, words)) > MAX_SEPARATORS * n and n > 3:
        return True
    if n >= PROSE_WORDS and not any(w.endswith(END) for w in words):
        return True
    if n > 2 and sum(w.lower() in PAGE_NAMES for w in words) >= MAX_PAGE_NAMES * n and not any(w.endswith(END) for w in words):
        return True
    if n < 4:
        return False
    stripped = len(line) - len(line.translate(None, SYMBOLS))
    if stripped >= n * MAX_SYMBOL_WORDS and sum(len(w) > len(w.translate(None, SYMBOLS)) for w in words) >= MAX_SYMBOL_WORDS * n:
        return True
    if b"!!" in line and sum(w.endswith(b"!!") for w in words) >= MAX_SHOUTED * n:
        return True
    return BOILERPLATE.search(line.lower()) is not None


def is_entry(words: list[bytes]) -> bool:
    """Whether a line's words may be an entry of a menu: few, capitalised, and none ends a sentence."""
    return len(words) <= ENTRY_WORDS and all(b"A" <= w[:1] <= b"Z" and not w.endswith(END) for w in words)


def failing(lines: list[bytes]) -> list[bool]:
    """Which lines fail on their own or as part of a menu; lines without words neither fail nor end a menu."""
    out = [bool(x.split()) and line_fails(x) for x in lines]
    menu: list[int] = []
    for k, line in enumerate([*lines, b"."]):
        words = line.split()
        if words and is_entry(words):
            menu.append(k)
        elif words:
            if len(menu) >= MENU_LINES:
                for at in menu:
                    out[at] = True
            menu = []
    return out


def clean(text: bytes) -> tuple[bytes, int, int]:
    """The text without failing lines, its number of words and that of the failing lines."""
    kept, words, lost = [], 0, 0
    lines = text.split(b"\n")
    for line, fails in zip(lines, failing(lines)):
        n = len(line.split())
        words += n
        if fails:
            lost += n
        else:
            kept.append(line)
    return b"\n".join(kept), words, lost


def repeated_words(h: np.ndarray, counts: np.ndarray, size: int = 3) -> np.ndarray:
    """For each text the number of words in ``size``-word windows that it holds twice or more."""
    out = np.zeros(len(counts), dtype=np.int64)
    every, at = windows(h, size), 0
    for k, n in enumerate(counts.tolist()):
        if n > size:
            _, which, times = np.unique(every[at : at + n - size + 1], return_inverse=True, return_counts=True)
            again = (times > 1)[which]
            if again.any():
                covered = np.zeros(n, dtype=bool)
                for j in range(size):
                    covered[j : j + len(again)] |= again
                out[k] = covered.sum()
        at += n
    return out


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """Base measures, verdict and cleaned text of each document.

    One row ``(id, *extra, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, cleaned)`` for each row of ``docs``; ``extra`` names columns to
    carry along, as ``extra_0``, ``extra_1``, .... Null and blank texts have no
    words, so they fail; repeated rows and ties are judged alike, each on its own;
    other columns are ignored, whatever their names. ``cleaned`` is the text without
    failing lines. There is no shuffle; a task holds one batch of texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("_text"), *(F.col(c).alias(f"extra_{k}") for k, c in enumerate(extra or [])))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    schema = f"{kinds}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, cleaned string"

    def columns(b: pa.RecordBatch) -> list:
        texts = as_bytes(b.column(1))
        n_words, repeats = [], []
        for i, j in slices(texts):
            h, counts = word_hashes(texts[i:j], lower=False)
            n_words += counts.tolist()
            repeats += repeated_words(h, counts).tolist()
        cleaned = [clean(x) for x in texts]
        failed = [n < 50 or 100 * r > 50 * n for n, r in zip(n_words, repeats)]
        return [
            b.column(0),
            *b.columns[2:],
            n_words,
            [len(x.translate(None, SPACES).decode("utf-8", "replace")) for x in texts],
            [len(x) - len(x.translate(None, SYMBOLS)) for x in texts],
            [duplicate_lines(x) for x in texts],
            repeats,
            failed,
            [not f and lost <= MAX_LOST * n for f, (_, n, lost) in zip(failed, cleaned)],
            pa.array([x for x, _, _ in cleaned], pa.binary()).cast(pa.string()),
        ]

    return map_arrow(rows, columns, schema).withColumnRenamed("id", id_col)
