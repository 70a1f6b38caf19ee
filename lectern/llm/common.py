"""What the operators of this subpackage share: the shared folder, intermediate
tables, Arrow batch limits and vectorised word hashing."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import BATCH_BYTES, bounded_batches, remove, scope, stored, workspace

#: Rows of a batch that a function gets at once.
BATCH_ROWS = 128


scratch, written = workspace, stored


_LOCK = threading.Lock()
#: By session setting that is overridden: how many hold it so, and its old value.
_HELD: dict[tuple[int, str], list] = {}


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Plan and run with a session setting; when the last of several threads leaves, it has its old value."""
    at = id(spark), key
    with _LOCK:
        held = _HELD.setdefault(at, [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                del _HELD[at]
                if held[1] is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, held[1])


def ranked(df: DataFrame, *order: Column, to: str = "rank") -> DataFrame:
    """Add each row's place from 1 in the order, without all rows in one task.

    Rows are dealt to ranges and numbered inside them; only the ranges' sizes, one row
    for each partition, meet in one task and go to all.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(to, F.col("_before") + place).drop("_part", "_before")


def map_arrow(df: DataFrame, columns: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """Map each Arrow batch, of at most ``BATCH_ROWS`` rows, to the columns of ``schema``."""
    return stream_arrow(df, lambda batches: map(columns, batches), schema)


def stream_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[list]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Map a partition's Arrow batches, in order, to lists of the columns of ``schema``; ``rows`` bounds a batch of rows that are short."""
    to = arrow_schema(schema)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(part for b in batches for part in parts(b, rows)):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, to)], schema=to)

    return df.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows and ``BATCH_BYTES`` bytes at most; a larger row stands alone.

    Spark bounds the bytes of what it sends by a setting, see ``bounded_batches``, which stands in the session.
    """
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > BATCH_BYTES):
        half = batch.num_rows // 2
        yield from parts(batch.slice(0, half), rows)
        yield from parts(batch.slice(half), rows)
    else:
        yield batch


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# Word hashing -------------------------------------------------------------

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _S32)) * _M2
    x = (x ^ (x >> _S32)) * _M2
    return x ^ (x >> _S32)


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes each; a longer text stands alone."""
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` in order, and each text's number of words.

    With ``lower``, A-Z count as a-z. Words are read eight bytes at a time.
    """
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    length = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = length.astype(np.uint64) * _M1
    live, at, left = np.arange(len(starts)), starts, length
    while len(live):
        part = eight[at] & _MASK[np.minimum(left, 8)]
        h[live] = mix(h[live] * _M1 ^ part)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    bounds = np.cumsum([len(x) + 1 for x in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return h, counts


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive values."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * _M1 ^ h[k : k + n])
    return out
