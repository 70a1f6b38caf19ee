"""Vector retrieval: best chunks of each collection, merged, with their provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chunk import chunks
from ..sources.tables import bounded_batches, remove, scope, stored

PER_COLLECTION, TOP = 3, 5
#: Vectors of one block at most, of questions and of chunks.
ASKED, HELD = 256, 1024


def distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "l2") -> Column:
    """``1 - distance``; for unit vectors the cosine with ``metric='cosine'``."""
    if metric == "cosine":
        product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
        return product(a, b) / F.sqrt(product(a, a) * product(b, b))
    return 1 - distance(a, b)


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """``(scope, keys, vectors)``: rows ``(scope, *keys, v)`` as blocks of one scope, as many as lie together."""
    keys = [f.name for f in df.schema if f.name not in ("scope", "v")]
    fields = ", ".join(f"{k}: {df.schema[k].dataType.simpleString()}" for k in keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.asarray(b.column("scope").dictionary_encode(null_encoding="encode").indices)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            places = [part[i : i + rows] for part in np.split(order, cuts) for i in range(0, len(part), rows) if len(part)]
            key_table = pa.StructArray.from_arrays([b.column(k) for k in keys], keys)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, places)]), pa.int32()), x.take(pa.array(np.concatenate(places))))
            if places:
                yield pa.RecordBatch.from_arrays([b.column("scope").take(pa.array([x[0] for x in places])), lists(key_table), lists(b.column("v"))], ["scope", "keys", "vectors"])

    return df.mapInArrow(pack, f"scope {df.schema['scope'].dataType.simpleString()}, keys array<struct<{fields}>>, vectors array<array<float>>")


def _scores(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def score(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
        product = asked @ held.T
        a, h = (asked * asked).sum(axis=1)[:, None], (held * held).sum(axis=1)[None, :]
        # equal vectors get equal scores, whatever else is in their blocks
        return np.round(product / np.sqrt(a * h) if metric == "cosine" else 1 - (a + h - 2 * product), 12)

    return score


def _best_of_block(scores: np.ndarray, codes: np.ndarray, places: np.ndarray, k: int, top: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each question's ``k`` best chunks of every collection, and of these its ``top`` best."""
    wide = lambda x: np.broadcast_to(x, scores.shape)
    order = np.lexsort((wide(places), -scores, wide(codes)), axis=1)
    own = codes[order]
    new = np.concatenate((np.ones((len(own), 1), bool), own[:, 1:] != own[:, :-1]), axis=1)
    at = np.arange(own.shape[1])
    found = at - np.maximum.accumulate(np.where(new, at, 0), axis=1) < k
    if not top or own.shape[1] <= top:
        rows, n = np.nonzero(found)
        return rows, order[rows, n]
    chosen = np.zeros(scores.shape, bool)
    np.put_along_axis(chosen, order, found, axis=1)
    best = np.lexsort((wide(places), wide(codes), -scores, ~chosen), axis=1)[:, :top]
    rows, n = np.nonzero(np.take_along_axis(chosen, best, axis=1))
    return rows, best[rows, n]


def scored(
    chunks_: DataFrame, questions: DataFrame, collection: str = "content_hash", index: str = "chunk_index", k: int = PER_COLLECTION, scope: str | None = None, top: int | None = None, metric: str = "l2"
) -> DataFrame:
    """``(question_id, collection, index, score)``: each block's best ``k`` chunks of each collection for each question.

    ``questions`` has ``question_id``, of any type, and ``embedding``; a null vector is never found and
    finds nothing. With ``scope``, a column of both, a question meets only the chunks of its own scope.
    Blocks of questions are joined with blocks of chunks, by scope or each with each, and a pair
    of blocks is one product of matrices; Spark broadcasts the questions' blocks if they are
    small. With ``top``, only rows that can be among so many of a question are returned.
    """
    own = lambda df: F.col(scope) if scope else F.lit(0)
    asked = _blocks(questions.where("embedding is not null").select(own(questions).alias("scope"), "question_id", F.col("embedding").cast("array<float>").alias("v")), ASKED)
    held = chunks_.where("embedding is not null").select(own(chunks_).alias("scope"), F.col(collection).alias("c"), F.col(index).cast("bigint").alias("i"), F.col("embedding").cast("array<float>").alias("v"))
    if scope:  # a block is of one scope, so those of a scope lie together; a hot one over several ranges
        held = held.repartitionByRange("scope", "c", "i").sortWithinPartitions("scope")
    asked = asked.select("scope", F.col("keys.question_id").alias("q"), F.col("vectors").alias("asked"))
    held = _blocks(held, HELD).select("scope", F.col("keys.c").alias("c"), F.col("keys.i").alias("i"), F.col("vectors").alias("held"))
    pairs = held.join(asked, "scope") if scope else held.drop("scope").crossJoin(asked.drop("scope"))
    score = _scores(metric)

    def matrix(vectors: pa.Scalar) -> np.ndarray:
        inner = vectors.values
        return inner.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(inner), -1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, of, c, i, on in zip(b.column("q"), b.column("asked"), b.column("c"), b.column("i"), b.column("held")):
                scores = score(matrix(of), matrix(on))
                codes = np.asarray(pc.rank(c.values, tiebreaker="dense")).astype(np.int64)
                places = i.values.to_numpy()
                rows, cols = _best_of_block(scores, codes, places, k, top)
                yield pa.RecordBatch.from_arrays([q.values.take(pa.array(rows)), c.values.take(pa.array(cols)), i.values.take(pa.array(cols)), pa.array(scores[rows, cols])], ["question_id", "collection", "index", "score"])

    bounded_batches(questions.sparkSession)  # a pair of blocks is a long row
    kinds = questions.schema["question_id"].dataType.simpleString(), chunks_.schema[collection].dataType.simpleString()
    return pairs.select("q", "asked", "c", "i", "held").mapInArrow(best, f"question_id {kinds[0]}, collection {kinds[1]}, index bigint, score double")


def merged(scores: DataFrame, per_collection: int = PER_COLLECTION, top: int = TOP) -> DataFrame:
    """The best ``top`` over all collections, at most ``per_collection`` of each, with ``rank`` from 1.

    Ties go to the smaller collection and index. Both limits are pushed below the
    shuffle as partial limits.
    """
    own = Window.partitionBy("question_id", "collection").orderBy(F.desc("score"), "index")
    every = Window.partitionBy("question_id").orderBy(F.desc("score"), "collection", "index")
    best = scores.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_collection).drop("_n")
    return best.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= top)


def with_provenance(hits: DataFrame, chunks_: DataFrame, sources: DataFrame) -> DataFrame:
    """Add text, page and file name; a content's first source names it, ``unknown`` without one."""
    names = sources.groupBy("content_hash").agg(F.min_by("filename", "id").alias("filename"))
    texts = chunks_.select(F.col("content_hash").alias("collection"), F.col("chunk_index").cast("bigint").alias("index"), F.col("document").alias("text"), "page")
    found = hits.join(texts, ["collection", "index"], "left").join(names.withColumnRenamed("content_hash", "collection"), "collection", "left")
    return found.withColumn("filename", F.coalesce("filename", F.lit("unknown")))


def collection_texts(scores: DataFrame, chunks_: DataFrame, k: int = TOP) -> DataFrame:
    """``(question_id, collection, text)``: the ``k`` best chunks of each collection, best first, two line feeds apart."""
    own = Window.partitionBy("question_id", "collection").orderBy(F.desc("score"), "index")
    best = scores.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= k)
    texts = chunks_.select(F.col("content_hash").alias("collection"), F.col("chunk_index").cast("bigint").alias("index"), F.col("document").alias("_text"))
    laid = F.transform(F.sort_array(F.collect_list(F.struct("_n", "_text"))), lambda x: x["_text"])
    return best.join(texts, ["collection", "index"]).groupBy("question_id", "collection").agg(F.array_join(laid, "\n\n").alias("text"))


def without_collections(chunks_: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks but for those of the collections in ``gone (content_hash)``."""
    return chunks_.join(gone.select("content_hash"), "content_hash", "left_anti")


def drop_collections(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """Remove collections from the chunks stored at ``path``, by ``prefix``; only prefixes with one of them are read and written."""
    gone = gone.select("content_hash").distinct()
    touched = sorted(r[0] for r in gone.select(F.substring("content_hash", 1, 2)).distinct().collect())  # at most 256
    with scope(spark):
        found = spark.read.parquet(path).schema  # in which prefixes of digits alone are numbers
        held = spark.read.schema(T.StructType([T.StructField("prefix", T.StringType()) if f.name == "prefix" else f for f in found])).parquet(path)
        left = stored(without_collections(held.where(F.col("prefix").isin(touched)), gone), "left")
        full = {r[0] for r in left.select("prefix").distinct().collect()}
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)
        for prefix in touched:
            if prefix not in full:
                remove(spark, f"{path}/prefix={prefix}")


def reset(spark: SparkSession, path: str) -> None:
    """Remove all collections stored at ``path``."""
    remove(spark, path)


def missing_collections(wanted: DataFrame, chunks_: DataFrame, entries: DataFrame) -> DataFrame:
    """Registry entries of wanted hashes whose chunks are gone; hashes without an entry stay away."""
    lost = wanted.select("content_hash").distinct().join(chunks_.select("content_hash"), "content_hash", "left_anti")
    return entries.join(lost, "content_hash", "left_semi").where(F.length("extracted_text") > 0)


def rebuilt(entries: DataFrame) -> DataFrame:
    """Chunks of registry entries, made again from their text."""
    return chunks(entries, F.col("extracted_text"), "content_hash")
