"""Streaming ingestion: content-keyed, first writer wins, safe to replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.hashing import collection_name
from ..sources.tables import scope, stored

REGISTRY = "content_hash string, collection string, extracted_text string, char_count bigint, first_id bigint, prefix string, batch bigint"
FILTER = "word bigint, bits bigint, prefix string, batch bigint"
#: Hexadecimal digits of a hash that name its partition (few for a small table), bits of a prefix's filter, and bits that an entry sets.
#: With n entries of a prefix, a new hash seems known with a probability of about (1 - exp(-4 n / BITS)) ** 4.
DIGITS, BITS, MARKS = 2, 1 << 26, 4


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(path)


def _prefix(h: Column, digits: int) -> Column:
    return F.substring(h, 1, digits)


def _marks(hashes: DataFrame, bits: int, digits: int) -> DataFrame:
    """``(content_hash, prefix, word, mask)``: the bits that each hash has in the filter of its prefix."""
    places = F.array(*(F.pmod(F.xxhash64(F.lit(k), "content_hash"), F.lit(bits)) for k in range(MARKS)))
    rows = hashes.select("content_hash", _prefix(F.col("content_hash"), digits).alias("prefix"), F.explode(F.array_distinct(places)).alias("_at"))
    return rows.select("content_hash", "prefix", F.expr("_at div 64").alias("word"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("mask"))


def filter_of(hashes: DataFrame, bits: int = BITS, digits: int = DIGITS) -> DataFrame:
    """``(word, bits, prefix)``: Bloom filters of hashes by prefix, as the words that are not zero."""
    return _marks(hashes, bits, digits).groupBy("word", "prefix").agg(F.bit_or("mask").alias("bits")).select("word", "bits", "prefix")


def maybe_known(hashes: DataFrame, filters: DataFrame, bits: int = BITS, digits: int = DIGITS) -> DataFrame:
    """The ``content_hash`` of those rows that the filters may hold; those left out are new for certain."""
    marks = _marks(hashes, bits, digits)
    words = filters.groupBy("prefix", "word").agg(F.bit_or("bits").alias("bits"))
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) != 0, F.lit(False))
    return marks.join(words, ["prefix", "word"], "left").groupBy("content_hash").agg(F.bool_and(hit).alias("_all")).where("_all").select("content_hash")


def registering(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text", bits: int = BITS, digits: int = DIGITS) -> DataStreamWriter:
    """A writer that appends each batch's new contents to the registry table at ``path``.

    The registry lies by the first digits of its hashes and by batch, and beside it, at ``path + "-filter"``, a
    Bloom filter for each prefix. A batch is deduplicated by hash; hashes that the filters do not hold are new,
    and only the others are anti-joined with entries, of the prefixes that they have. Each batch has partitions of its own,
    overwritten if the batch is replayed, so a restart neither loses nor repeats entries. A null text has no entry.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for table, schema in ((path, REGISTRY), (path + "-filter", FILTER)):
            spark.createDataFrame([], schema).write.mode("append").partitionBy("prefix", "batch").parquet(table)
        with scope(spark):
            hashed = stored(batch.select(F.sha2(text_col, 256).alias("content_hash"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null"), "hashed")
            first = stored(hashed.groupBy("content_hash").agg(F.min("id").alias("first_id")), "first")
            maybe = stored(maybe_known(first.select("content_hash"), touched(spark, path + "-filter", FILTER, first, number, digits), bits, digits), "maybe")
            known = maybe.join(touched(spark, path, REGISTRY, maybe, number, digits).select("content_hash"), "content_hash", "left_semi")
            new = stored(first.join(known, "content_hash", "left_anti"), "new")
            # the text of the first writer, by its id; others of the content are not carried along
            texts = hashed.join(new.select("content_hash", F.col("first_id").alias("id")), ["content_hash", "id"], "left_semi").dropDuplicates(["content_hash"])
            rows = texts.select("content_hash", collection_name(F.col("content_hash")).alias("collection"), F.col("text").alias("extracted_text"), F.length("text").cast("bigint").alias("char_count"), F.col("id").alias("first_id"))
            own = lambda df: df.withColumn("batch", F.lit(number).cast("bigint")).hint("rebalance", "prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch")
            # of a first attempt, a prefix may be there that this one does not have; it has the same rows, as a batch is the same
            own(filter_of(new.select("content_hash"), bits, digits)).parquet(path + "-filter")
            own(rows.withColumn("prefix", _prefix(F.col("content_hash"), digits)).select(*[c for c in REGISTRY.replace(",", "").split()[::2] if c != "batch"])).parquet(path)

    return docs.writeStream.foreachBatch(write)


def touched(spark: SparkSession, path: str, schema: str, hashes: DataFrame, number: int, digits: int = DIGITS) -> DataFrame:
    """The rows of earlier batches at ``path`` with a prefix of ``hashes``; other partitions are not read."""
    prefixes = sorted(r[0] for r in hashes.select(_prefix(F.col("content_hash"), digits)).distinct().collect())  # 16 ** digits at most
    return spark.read.schema(schema).parquet(path).where(F.col("prefix").isin(prefixes) & (F.col("batch") < number))


def deduplicated(docs: DataFrame, key: str, time: str | None = None, within: str = "1 day") -> DataFrame:
    """One row for each key; with ``time``, keys are forgotten after ``within``, so state stays bounded."""
    if time is None:
        return docs.dropDuplicates([key])
    return docs.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what is there and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def for_each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    run_available(stream.writeStream.foreachBatch(apply), checkpoint)
