"""Approximate retrieval by an inverted file: vectors lie by their nearest centroid, and a question reads the nearest lists alone.

Centroids are fitted on a sample of at most ``SAMPLE`` vectors, those with the smallest hash of
their keys; every vector is assigned and stored, in a partition for each list. How many lists a search reads is
fitted too: for ``TRIALS`` vectors as questions, the exact answer, themselves left out, tells how near the lists of its
hits are, and so many lists are read that ``RECALL`` of the hits are found. A search takes the nearest lists of each
question; the lists touched by any question, at most as many as there are, prune the table's partitions, and inside a
list the blocks of ``retrieval.scored`` do the work. With all lists probed the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import bounded_batches, stored
from . import retrieval

#: Vectors that centroids are fitted on, lists, and rounds, at most; vectors asked to fit the number of lists read, and the hits it is to find.
SAMPLE, LISTS, ROUNDS, TRIALS, RECALL = 20_000, 1024, 12, 200, 0.95
SEED = 7
#: Distances to centroids and components of repeated vectors that a worker makes at once.
AT_ONCE = 1 << 18


@dataclass
class Index:
    """``path`` holds ``(content_hash, chunk_index, embedding)`` and more by ``list``; ``centroids`` is ``[list, component]``; a search reads ``probes`` lists."""

    path: str
    centroids: np.ndarray
    probes: int


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.round((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)[None, :], 9)


def _slices(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that with ``lists`` for each they are ``AT_ONCE`` at most; never an empty one."""
    for b in batches:
        for k in range(0, b.num_rows, rows := max(1, AT_ONCE // max(1, lists))):
            yield b.slice(k, rows)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's centroids of a sample; seeds are drawn by squared distance, and a list that empties keeps its place."""
    rng = np.random.default_rng(SEED)
    chosen = sample[[rng.integers(len(sample))]]
    near = _distances(sample, chosen)[:, 0].clip(0)
    while len(chosen) < min(lists, len(sample)) and near.sum() > 0:
        chosen = np.vstack((chosen, sample[rng.choice(len(sample), p=near / near.sum())]))
        near = np.minimum(near, _distances(sample, chosen[-1:])[:, 0].clip(0))
    for _ in range(rounds):
        own = _distances(sample, chosen).argmin(axis=1)
        counts = np.bincount(own, minlength=len(chosen))
        sums = np.zeros_like(chosen)
        np.add.at(sums, own, sample)
        chosen = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], chosen)
    return chosen


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, keys: tuple[str, ...] = ("content_hash", "chunk_index")) -> np.ndarray:
    """Centroids of ``vectors``; by default about the root of their number of lists."""
    some = vectors.where("embedding is not null")
    if lists is None:
        lists = min(LISTS, max(1, math.isqrt(some.count())))
    rows = some.select(F.xxhash64(*keys).alias("_h"), "embedding").orderBy("_h", "embedding").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    return centroids_of(np.array([r.embedding for r in rows], dtype=float), min(lists, LISTS))


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with ``list``, the nearest centroid; null vectors are in no list and stay away."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, len(centroids)):
            own = _distances(_matrix(b.column("embedding")), centroids).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], [*b.schema.names, "list"])

    bounded_batches(vectors.sparkSession)
    some = vectors.where("embedding is not null")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema)
    return some.mapInArrow(assign, f"{fields}, list int")


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL, metric: str = "l2") -> Index:
    """Fit on the sample, assign all, write by list, fit ``probes``. A list's rows go over several tasks by their keys, so a large list is no large task."""
    centroids = fit(vectors, lists, sample)
    rows = assigned(vectors, centroids) if len(centroids) else vectors.where("false").withColumn("list", F.lit(0))
    rows.repartitionByRange("list", F.xxhash64("content_hash", "chunk_index")).write.partitionBy("list").option("compression", "zstd").parquet(path)
    held = vectors.sparkSession.read.schema(rows.schema).parquet(path)
    return Index(path, centroids, probes_for(held, centroids, recall, metric) if len(centroids) else 0)


def probes_for(held: DataFrame, centroids: np.ndarray, recall: float = RECALL, metric: str = "l2") -> int:
    """How many nearest lists hold ``recall`` of the hits of ``TRIALS`` stored vectors asked over all vectors."""
    trial = F.concat_ws("|", "content_hash", "chunk_index")
    asked = held.select(trial.alias("question_id"), "embedding").orderBy(F.xxhash64(F.lit(SEED), "question_id"), "question_id").limit(TRIALS)
    asked = stored(asked, "trials")
    scores = retrieval.scored(held, asked, k=retrieval.PER_COLLECTION + 1, top=retrieval.TOP + 1, metric=metric).where(F.concat_ws("|", "collection", "index") != F.col("question_id"))
    hits = retrieval.merged(scores).select("question_id", F.col("collection").alias("content_hash"), F.col("index").alias("chunk_index"))
    of_hits = held.select("content_hash", F.col("chunk_index").cast("bigint"), "list").join(hits, ["content_hash", "chunk_index"]).join(asked, "question_id")
    rows = of_hits.select("embedding", "list").collect()  # some for each trial
    if not rows:
        return len(centroids)
    near = np.argsort(_distances(np.array([r.embedding for r in rows], dtype=float), centroids), axis=1, kind="stable")
    places = np.sort(np.argmax(near == np.array([r.list for r in rows])[:, None], axis=1))
    return int(places[math.ceil(recall * len(places)) - 1]) + 1


def probed(questions: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``questions (question_id, embedding)`` once for each of its nearest lists, with ``list``."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a question's vector is repeated for each list, so a batch's would grow with the lists, and these with the table
        for b in _slices(batches, len(centroids) + probes * (len(centroids[0]) if len(centroids) else 0)):
            near = np.argsort(_distances(_matrix(b.column("embedding")), centroids), axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns), pa.array(near.ravel(), pa.int32())], [*b.schema.names, "list"])

    some = questions.where("embedding is not null").select("question_id", "embedding")
    return some.mapInArrow(lists, f"question_id {some.schema['question_id'].dataType.simpleString()}, embedding {some.schema['embedding'].dataType.simpleString()}, list int")


def opened(spark: SparkSession, index: Index, asked: DataFrame) -> DataFrame:
    """The index's rows of the lists that any question touches; other partitions are not read."""
    touched = sorted(r[0] for r in asked.select("list").distinct().collect())  # at most a number for each list
    return spark.read.parquet(index.path).where(F.col("list").isin(touched))


def search(
    questions: DataFrame, index: Index, probes: int | None = None, per_collection: int = retrieval.PER_COLLECTION, top: int = retrieval.TOP, metric: str = "l2"
) -> DataFrame:
    """The best ``top`` of each question, as ``retrieval.merged`` ranks them, among the vectors of its nearest lists.

    ``probes`` overrides the index's number; all lists or more make the search exact. A null vector finds nothing.
    """
    spark = questions.sparkSession
    asked = probed(questions, index.centroids, index.probes if probes is None else probes)
    scores = retrieval.scored(opened(spark, index, asked), asked, k=per_collection, scope="list", top=top, metric=metric)
    return retrieval.merged(scores, per_collection, top)
