"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

1. Each text becomes token ids and an end id, cut into pieces of ``capacity`` tokens; the
   last piece may be shorter. A task numbers its pieces within each length.
2. The number of pieces of each length, ``capacity`` numbers at most, is all that the plan
   needs: best-fit-decreasing over counts. Lengths go from long to short; pieces of one length
   go to the fullest sequences that have room for them, many alike sequences in one step. A step
   is an interval of ranks of one length, laid evenly over an interval of sequences.
3. A piece's rank within its length is its number in its task plus the pieces of that length
   in the tasks before. Steps are unrolled to slots ``(length, rank)`` in all tasks,
   and pieces take their slots by an equi-join, in which every key is unique.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, stream_arrow, text_or_empty, written
from .token_counts import drops_white_space

CAPACITY = 2048
#: Id after each document's last token.
END = 0
#: Words that a worker keeps encoded, and words that are encoded at once.
HELD_WORDS, AT_ONCE = 1_000_000, 200
#: Slots that one row unrolls to.
SLOTS = 4096
STEPS = "length int, first bigint, each bigint, bins bigint, sequence bigint, offset bigint"


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, by the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()


class WordEncoder(TextEncoder):
    """The same for a tokenizer that drops white space: a text's ids are those of its words, one after another.

    Words not met before are encoded together, apart by spaces; where a token starts tells its word.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.held: dict[bytes, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        words = text.split()
        held = self.held
        missing = [w for w in set(words) if w not in held]
        if missing:
            found = self._encoded(missing)
            if len(held) < HELD_WORDS:
                held.update(found)
            else:
                return b"".join([found[w] if w in found else held[w] for w in words])
        return b"".join(map(held.__getitem__, words))

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        groups = range(0, len(texts), AT_ONCE)
        out = {}
        for i, e in zip(groups, self.tokenizer.encode_batch([" ".join(texts[i : i + AT_ONCE]) for i in groups], add_special_tokens=False)):
            ends = np.cumsum([len(t) + 1 for t in texts[i : i + AT_ONCE]])
            starts = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e))
            cuts = (4 * np.searchsorted(starts, ends)).tolist()
            data, at = np.array(e.ids, dtype="<u4").tobytes(), 0
            for w, cut in zip(words[i : i + AT_ONCE], cuts):
                out[w] = data[at:cut]
                at = cut
        return out


_held: dict[str, TextEncoder] = {}


def _encoder(path: str, kind: type) -> TextEncoder:
    if path not in _held:
        _held[path] = kind(path)
    return _held[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, part, nth[, ids])``: the pieces of each text's ids and ``end``.

    ``nth`` numbers, from 0, the pieces of one length in the task ``part``. Both depend on the
    rows of a task alone, so a task that runs again gives the same; they hold for
    one written table.
    """
    kind = WordEncoder if drops_white_space(path) else TextEncoder
    closing = np.array([end], dtype="<u4").tobytes()
    size = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterable[list]:
        encoder, part, seen = _encoder(path, kind), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            rows, piece, start, length, crc, nth, made = [], [], [], [], [], [], []
            for k, text in enumerate(as_bytes(b.column(1))):
                data = encoder.encode(text) + closing
                for n, at in enumerate(range(0, len(data), size)):
                    own = data[at : at + size]
                    tokens = len(own) // 4
                    rows.append(k), piece.append(n), start.append(at // 4), length.append(tokens), crc.append(zlib.crc32(own)), nth.append(seen[tokens])
                    seen[tokens] += 1
                    if with_ids:
                        made.append(np.frombuffer(own, dtype="<i4"))
            yield [b.column(0).take(pa.array(rows, pa.int64())), piece, start, length, crc, [part] * len(rows), nth, *([pa.array(made, pa.list_(pa.int32()))] if with_ids else [])]

    kind_of_id = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind_of_id}, piece int, start bigint, length int, ids_crc32 bigint, part int, nth bigint" + (", ids array<int>" if with_ids else "")
    return stream_arrow(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), cut, schema)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit-decreasing over ``counts`` of lengths: steps ``(length, first, each, bins, sequence, offset)`` and the number of sequences.

    A step lays the pieces of a length with ranks from ``first`` on, ``each`` to a sequence, into ``bins``
    sequences from ``sequence`` on, in each from ``offset`` on. Groups of alike sequences split at
    most twice for each length, so steps are few however many pieces there are.
    """
    steps: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room to (first sequence, how many)
    rooms: list[int] = []  # those of groups, ascending
    total = 0

    def add(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, bins))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, bins = capacity, total, -(-left // (capacity // length))
                total += bins
            each = room // length
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0  # fewer than ``each``: one sequence more takes them
            for per, n, at_bin in ((each, full, first), (rest, 1, first + full)):
                if per and n:
                    steps.append((length, rank, per, n, at_bin, capacity - room))
                    add(room - per * length, at_bin, n)
                    rank += per * n
                    left -= per * n
            used = full + (rest > 0)
            add(room, first + used, bins - used)
    return steps, total


def slots(steps: DataFrame) -> DataFrame:
    """``(length, rank, sequence_id, offset)``: a row for each piece that the steps lay."""
    last = F.col("each") * F.col("bins") - 1
    blocks = steps.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(SLOTS).cast("bigint"))))
    n = F.explode(F.sequence("_from", F.least(F.col("_from") + SLOTS - 1, last)))
    each = blocks.repartition("length", "first", "_from").withColumn("_n", n)
    return each.select(
        "length", (F.col("first") + F.col("_n")).alias("rank"), (F.col("sequence") + F.expr("_n div each")).alias("sequence_id"), (F.col("offset") + F.col("_n") % F.col("each") * F.col("length")).alias("offset")
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``: a row for each piece of each document.

    A document is the ids of its text by the tokenizer at ``path``, without added special tokens, and ``end``; one
    longer than ``capacity`` is cut into pieces of ``capacity`` tokens and a rest. A piece stands in
    its sequence from ``offset`` on; sequences are numbered from 0 and filled from the
    start without gaps. Null and empty texts are the end id alone, a piece of one token.
    Repeated rows are documents of their own, also with a null id; an empty table has no
    pieces; other columns are ignored, whatever their names. Which of two pieces of one
    length goes where is arbitrary. At most ``capacity`` counts come to the driver.
    """
    spark = docs.sparkSession
    made = written(pieces(docs, path, capacity, end, with_ids, id_col, text_col), "pieces")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counted = made.groupBy("length", "part").agg(F.count("*").alias("_n"))
    counted = written(counted.select("length", "part", "_n", F.coalesce(before, F.lit(0)).alias("_before")), "lengths")
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    steps, _ = best_fit(counts, capacity)
    ranked = written(made.join(counted.drop("_n"), ["length", "part"]).withColumn("rank", F.col("_before") + F.col("nth")).drop("part", "nth", "_before"), "ranked")
    laid = ranked.join(written(slots(spark.createDataFrame(steps, STEPS)), "slots"), ["length", "rank"])
    return laid.select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, starts)``: the packed sequences as rows; ``starts`` are the offsets at which a piece begins.

    A sequence has at most ``capacity`` tokens, so its row is bounded.
    """
    laid = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(laid.alias("_laid")).select("sequence_id", F.flatten(F.col("_laid.ids")).alias("ids"), F.col("_laid.offset").alias("starts"))
