"""How far the sources of a language differ in their words: divergences from counts kept as bitmaps.

1. Terms are counted by (language, source), with the number of documents that hold them. A
   language keeps the terms that enough of its documents hold, numbered from the commonest on.
2. A source's counts become bitmaps: for each count, and each 64 terms, a word of the bits of the
   terms that the source holds so often. Common terms share a count with none; of the many
   rare ones, a word holds a whole level.
3. For two sources, AND and popcount of a level of one and a level of the other give the
   number of terms in that joint cell. All terms of a cell have the same two probabilities, so the
   cell counts that often. Terms that one of the two lacks, or both, need no bitmap: they are the complement.
4. Sources are dealt to blocks of ``BLOCK``, terms to chunks of ``CHUNK``. A task adds up all chunks of
   two blocks that it has and tells one sum for each two sources.

The value of a term with probabilities p and q is ``f = floor((p - q) * (p - q) / q)``, in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, ranked, stream_arrow, text_or_empty, written

#: Probabilities are whole numbers out of so many.
UNIT = 1_000_000_000
#: Documents of a language that a kept term is in at least, and terms reported of each source at most.
MIN_DOCS, TOP = 3, 200
#: Sources of a block, and terms of a chunk (a multiple of 64).
BLOCK, CHUNK = 64, 256
#: Levels that a task reads at once.
BATCH = 8192
#: Counts that a task gathers before it passes them on; levels of a word that meet at once.
GATHERED, ROWS_AT_ONCE = 200_000, 512

#: Upper case A-Z becomes lower case, other ASCII characters but letters a space; bytes of other characters stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, n_docs)``: occurrences of each term and documents with it; a null term for each source.

    Nulls are empty strings. Each task adds up what it reads, as far as ``GATHERED`` counts go.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[list]:
        held: dict[tuple, dict[bytes, list]] = {}
        size = 0

        def told() -> list:
            groups = [(g, terms) for g, terms in held.items()]
            lengths = [len(terms) + 1 for _, terms in groups]
            place = np.repeat(np.arange(len(groups)), lengths)
            column = lambda k: pa.array([g[k] for g, _ in groups], pa.string()).take(pa.array(place))
            found = pa.array([t for _, terms in groups for t in (None, *terms)], pa.binary()).cast(pa.string())
            n, d = (pa.array([x for _, terms in groups for x in (0, *(v[k] for v in terms.values()))], pa.int64()) for k in (0, 1))
            return [column(0), column(1), found, n, d]

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                for t, n in Counter(text.translate(_TERMS).split()).items():
                    if t in terms:
                        terms[t][0] += n
                        terms[t][1] += 1
                    else:
                        terms[t] = [n, 1]
                size += len(terms) - before
                if size > GATHERED:
                    yield told()
                    held, size = {}, 0
        if held:
            yield told()

    rows = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    parts = stream_arrow(rows, count, "lang string, source string, term string, n bigint, n_docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", (wide(count) + F.lit(1)) * F.lit(UNIT), wide(total) + wide(terms)).cast("bigint")


def value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q).cast("bigint")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _chunk_sums(p0: np.ndarray, q0: np.ndarray, width: int, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sums of f over ``width`` terms for each source of a block with each of another.

    ``p0, q0``: the sources' probabilities of a term they lack. ``left, right``: levels as (source, probability, word, bits).
    Whatever is in no joint cell is the complement: first all terms count as lacking in both, then those
    of a level as lacking in the other, and each joint cell takes back what it does not lack.
    """
    neither = _f(p0[:, None], q0[None, :])
    out = neither * np.int64(width)
    a, pa_, wa, ba = left
    b, pb, wb, bb = right
    np.add.at(out, a, np.bitwise_count(ba).astype(np.int64)[:, None] * (_f(pa_[:, None], q0[None, :]) - neither[a]))
    np.add.at(out.T, b, np.bitwise_count(bb).astype(np.int64)[:, None] * (_f(p0[None, :], pb[:, None]) - neither.T[b]))
    # levels come in the order of their words, so those of one word lie together
    words = np.intersect1d(wa, wb)
    for i0, i1, j0, j1 in zip(*(np.searchsorted(w, words, side).tolist() for w in (wa, wb) for side in ("left", "right"))):
        for at in range(i0, i1, ROWS_AT_ONCE):
            to = min(at + ROWS_AT_ONCE, i1)
            cells = ba[at:to, None] & bb[None, j0:j1]
            i, j = np.nonzero(cells)
            n = np.bitwise_count(cells[i, j]).astype(np.int64)
            i, j = i + at, j + j0
            s, t, p, q = a[i], b[j], pa_[i], pb[j]
            np.add.at(out, (s, t), n * (_f(p, q) - _f(p, q0[t]) - _f(p0[s], q) + neither[s, t]))
    return out


def _pair_sums(rows: DataFrame) -> DataFrame:
    """``(lang, a, b, part)`` from the levels of two blocks, sorted by language, blocks and chunk; partial sums to be added."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterable[list]:
        own: tuple | None = None  # language and blocks now added up
        sums: np.ndarray | None = None
        parts: list[dict[str, np.ndarray]] = []
        chunk: tuple | None = None

        def close_chunk() -> None:
            nonlocal sums
            if not parts:
                return
            c = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
            parts.clear()
            sides = []
            for side in (0, 1):
                on = (c["side"] == side) | (c["side"] == 2)
                lacking = on & (c["word"] < 0)
                base = np.zeros(BLOCK, np.int64)
                base[c["source"][lacking] % BLOCK] = c["p"][lacking]
                level = on & (c["word"] >= 0)
                order = np.argsort(c["word"][level], kind="stable")
                sides.append((base, tuple(x[order] for x in (c["source"][level] % BLOCK, c["p"][level], c["word"][level], c["bits"][level].view(np.uint64))), lacking))
            width = int(c["bits"][sides[0][2]][0])
            (p0, left, _), (q0, right, _) = sides
            there = [np.flatnonzero(x) for x in (p0, q0)]
            place = [np.searchsorted(t, np.arange(BLOCK)) for t in there]
            made = _chunk_sums(p0[there[0]], q0[there[1]], width, (place[0][left[0]], *left[1:]), (place[1][right[0]], *right[1:]))
            if sums is None:
                sums = np.zeros((BLOCK, BLOCK), np.int64)
            sums[np.ix_(*there)] += made

        def told() -> list:
            lang, i, j = own
            n = np.arange(BLOCK * BLOCK)
            return [[lang] * len(n), i * BLOCK + n // BLOCK, j * BLOCK + n % BLOCK, sums.ravel()]

        for b in batches:
            lang = b.column("lang").dictionary_encode()
            names, column = lang.dictionary.to_pylist(), {k: np.asarray(b.column(k)) for k in ("i", "j", "chunk", "side", "source", "p", "word", "bits")}
            code = np.asarray(lang.indices)
            edges = np.flatnonzero(np.any([np.diff(x, prepend=-1) != 0 for x in (code, column["i"], column["j"], column["chunk"])], axis=0)).tolist()
            for at, to in zip(edges, [*edges[1:], b.num_rows]):
                key = names[code[at]], int(column["i"][at]), int(column["j"][at])
                if (key, column["chunk"][at]) != chunk:
                    close_chunk()
                    if own is not None and key != own:
                        yield told()
                        sums = None
                    own, chunk = key, (key, column["chunk"][at])
                parts.append({k: column[k][at:to].astype(np.int64) for k in ("side", "source", "p", "word", "bits")})
        close_chunk()
        if own is not None:
            yield told()

    return stream_arrow(rows, add_up, "lang string, a bigint, b bigint, part bigint", BATCH)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how each source of a language differs from the others, and in which terms.

    Terms are runs of letters A-Z (as lower case) and characters beyond ASCII; a language keeps those in at
    least ``min_docs`` of its documents. A source or language gives a term the probability
    ``1 + floor(10^9 * (count + 1) / (N + V))``, N its occurrences of the V kept terms.
    Part ``pair``: every other source of the language, with f summed over all kept
    terms. Part ``term``: the ``top`` terms that the source has and uses more than the language, with f. Ranks go from 1 by
    value descending, then item; all sums are exact. Null languages, sources and texts are
    empty strings; a source without terms, in a language without kept terms too, has its pairs (0 without
    terms). Repeated rows count each; an empty table has no rows; other columns are ignored, whatever their names.
    """
    counts = written(term_counts(docs, lang_col, source_col, text_col), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs).drop("n_docs")
    kept = ranked(written(kept, "kept"), F.col("lang"), F.desc("in_lang"), F.col("term"), to="id")
    kept = written(kept.select("lang", "term", (F.col("id") - 1).alias("id"), "in_lang"), "terms")
    held = written(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "in_lang"), "held")
    groups = _groups(counts, kept, held)

    of_group = groups.select("lang", "source", "place", "total", "terms", "lang_total", "from", "to")
    levels = written(held.join(of_group, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms"))), "levels")
    q = probability(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    terms = levels.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    return _ranked_pairs(groups, _bitmap_sums(groups, levels)).unionByName(terms)


def _groups(counts: DataFrame, kept: DataFrame, held: DataFrame) -> DataFrame:
    """A row for each (language, source): its place, the blocks of its language, totals and the range of term ids."""
    langs = kept.groupBy("lang").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    placed = ranked(groups.fillna(0, ["total", "terms", "lang_total"]), F.col("lang"), F.col("source"), to="place")
    placed = written(placed.withColumn("place", F.col("place") - 1), "placed")
    blocks = placed.groupBy("lang").agg(F.expr(f"min(place) div {BLOCK}").alias("from"), F.expr(f"max(place) div {BLOCK}").alias("to"))
    return written(placed.join(blocks, "lang"), "groups")


def _bitmap_sums(groups: DataFrame, levels: DataFrame) -> DataFrame:
    """``(lang, a, b, value)``: f summed over all kept terms, for every two places of a language."""
    bitmaps = levels.groupBy("lang", "place", "from", "to", F.expr("id div 64").alias("word"), "p").agg(F.expr("bit_or(shiftleft(1L, cast(id % 64 as int)))").alias("bits"))
    bitmaps = bitmaps.withColumn("chunk", F.expr(f"word div {CHUNK // 64}"))
    # of a source and a chunk: the probability of what it lacks, and the number of terms in all
    of_lang = groups.where("terms > 0").withColumn("chunk", F.explode(F.sequence(F.expr(f"first div {CHUNK}"), F.expr(f"last div {CHUNK}"))))
    width = F.least("last", (F.col("chunk") + 1) * CHUNK - 1) - F.greatest("first", F.col("chunk") * CHUNK) + 1
    lacking = of_lang.select("lang", "place", "from", "to", "chunk", F.lit(-1).cast("bigint").alias("word"), probability(F.lit(0), F.col("total"), F.col("terms")).alias("p"), width.alias("bits"))
    rows = bitmaps.unionByName(lacking).withColumn("own", F.expr(f"place div {BLOCK}")).withColumn("other", F.explode(F.sequence("from", "to")))
    sent = lambda side, i, j: F.struct(F.lit(side).alias("side"), F.col(i).alias("i"), F.col(j).alias("j"))
    # a block meets another on both sides, and itself once
    sides = F.explode(F.when(F.col("own") == F.col("other"), F.array(sent(2, "own", "own"))).otherwise(F.array(sent(0, "own", "other"), sent(1, "other", "own"))))
    met = rows.withColumn("x", sides).select("lang", "x.i", "x.j", "chunk", "x.side", F.col("place").alias("source"), "p", "word", "bits")
    met = met.repartition("lang", "i", "j", "chunk").sortWithinPartitions("lang", "i", "j", "chunk")
    return _pair_sums(met).groupBy("lang", "a", "b").agg(F.sum(F.col("part").cast("decimal(38,0)")).cast("bigint").alias("value"))


def _ranked_pairs(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """All pairs of sources of a language; those of a language without terms have no sums and count 0."""
    # sources meet by blocks: each goes to every block of its language, and there to the sources of that block
    sent = groups.select("lang", "source", F.col("place").alias("a"), F.explode(F.sequence("from", "to")).alias("block"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.expr(f"place div {BLOCK}").alias("block"))
    pairs = sent.join(others, ["lang", "block"]).where("a <> b").join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
