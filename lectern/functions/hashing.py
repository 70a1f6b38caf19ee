"""Names, keys and signatures derived from content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def collection_name(h: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(h, 1, 59))


def chunk_id(h: Column, index: Column) -> Column:
    return F.concat_ws("_", F.substring(h, 1, 16), index.cast("string"))


def content_signatures(sources: DataFrame, by: str = "notebook_id", h: str = "content_hash") -> DataFrame:
    """``(by, signature)``: digest of each notebook's sorted hashes, repeats included; null hashes do not count.

    A sequential digest needs its notebook's hashes in order, so a notebook is read by one
    task; it streams, and no row or group holds all its hashes.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in batches:
            out: tuple[list, list] = ([], [])
            for own, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest is None or own != key:
                    if digest is not None:
                        out[0].append(key)
                        out[1].append(digest.hexdigest())
                    key, digest = own, hashlib.sha256(x.encode())
                else:
                    digest.update(b"|" + x.encode())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column(0).type), pa.array(out[1], pa.string())], [by, "signature"])
            last = b
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], last.column(0).type), pa.array([digest.hexdigest()], pa.string())], [by, "signature"])

    rows = sources.where(F.col(h).isNotNull()).select(by, h)
    return rows.repartition(by).sortWithinPartitions(by, h).mapInArrow(digests, f"`{by}` {rows.schema[by].dataType.simpleString()}, signature string")


def ordered_signature(texts: Column) -> Column:
    """Twelve digits that stand for an array of texts in order."""
    return F.substring(F.sha2(F.array_join(texts, "|"), 256), 1, 12)
