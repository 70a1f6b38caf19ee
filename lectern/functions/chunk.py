"""Overlapping chunks of a text, cut at the widest separator that serves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import bounded_batches

SIZE, OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", " ", "")


def _merged(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    held: list[str] = []
    total = 0
    first = 0
    for piece in pieces:
        if total + len(piece) > size and first < len(held):
            yield "".join(held[first:])
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(held[first])
                first += 1
        held.append(piece)
        total += len(piece)
    if first < len(held):
        yield "".join(held[first:])


def _split(text: str, separators: tuple[str, ...], size: int, overlap: int) -> Iterator[str]:
    k = next(i for i, s in enumerate(separators) if s == "" or s in text)
    separator, rest = separators[k], separators[k + 1 :]
    if separator:
        first, *others = text.split(separator)
        pieces = [x for x in (first, *(separator + o for o in others)) if x]
    else:
        pieces = list(text)
    short: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        yield from _merged(short, size, overlap)
        short = []
        if rest:
            yield from _split(piece, rest, size, overlap)
        else:
            yield piece
    yield from _merged(short, size, overlap)


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """The chunks of a text, stripped; none of a blank one."""
    if not text or not text.strip():
        return []
    return [x for x in (c.strip() for c in _split(text, SEPARATORS, size, overlap)) if x]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks_of(texts: pd.Series) -> pd.Series:
    return texts.map(chunk_text)


def chunks(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """A row for each chunk: ``keep``, ``chunk_index``, ``page`` (the ordinal from 1) and ``document``."""
    bounded_batches(docs.sparkSession)
    exploded = docs.select(*keep, F.posexplode(chunks_of(text)).alias("chunk_index", "document"))
    return exploded.select(*keep, "chunk_index", (F.col("chunk_index") + 1).alias("page"), "document")


def dealt(made: DataFrame, key: Column) -> DataFrame:
    """Chunks dealt by ``key``, a large one over several tasks: what embeds them runs in tasks of its own.

    In the tasks that cut texts, each core would hold a worker that cuts and one that embeds.
    """
    return made.withColumn("_key", key).hint("rebalance", "_key").drop("_key")
