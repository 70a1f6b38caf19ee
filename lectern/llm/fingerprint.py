"""Canonical exact fingerprints, in DataFrame and SQL operations only.

A text's canonical form is its NFC, in lower case, with runs of white space as one
space and none at the ends. Its fingerprint is a wide hash of that form, two 64-bit
xxhashes. Texts whose hashes are equal share a bucket, and inside a bucket the
canonical bytes are compared; should they differ, a third hash is added to the
fingerprints of the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written


def canonical(text: Column) -> Column:
    nfc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.btrim(F.regexp_replace(F.lower(nfc), r"[\s\x{85}\p{Z}]+", " "))


def seeded(canon: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), canon)


def wide_hash(canon: Column) -> Column:
    """128 bits: two 64-bit xxhashes with different seeds."""
    half = lambda seed: F.lpad(F.hex(seeded(canon, seed)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


#: Stands for a null id among the keys; as an id of its own it counts as null.
NO_ID = -(1 << 63)


def ring(rows: DataFrame) -> DataFrame:
    """Add ``after`` and ``before`` to the distinct ``(k, h, row)``: the neighbours' ``row`` in a ring.

    The order is by descending ``k``, then ``h``; after the last comes the first. Rows are
    dealt to ranges and ordered inside them; only the two ends of each range, as many
    rows as there are partitions, meet to join the ranges up.
    """
    dealt = written(rows.repartitionByRange(F.desc("k"), F.asc("h")).withColumn("part", F.spark_partition_id()), "ranges")
    place = F.struct("k", F.bitwise_not("h"))
    ends = dealt.groupBy("part").agg(F.max_by("row", place).alias("first"), F.min_by("row", place).alias("last"))
    parts = Window.orderBy("part")
    every = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(parts), F.first("first").over(every)).alias("next_first"),
        F.coalesce(F.lag("last").over(parts), F.last("last").over(every)).alias("prev_last"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc("k"), F.asc("h"))
    return (
        dealt.withColumn("_lead", F.lead("row").over(inside))
        .withColumn("_lag", F.lag("row").over(inside))
        .join(F.broadcast(ends), "part")  # a row for each partition
        .select("k", "h", "row", F.coalesce("_lead", "next_first").alias("after"), F.coalesce("_lag", "prev_last").alias("before"))
    )


def fingerprints(docs: DataFrame, hash_of=wide_hash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    An edited text has its last ``floor(n_chars / 3)`` code points replaced by the first
    as many, or all, of the next document's text, in descending order of ids; the last
    is followed by the first. One row ``(id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)`` for each row of ``docs``; the likeness
    of two exact fingerprints is 1 or 0. A null text counts as empty; rows with equal id
    and text are one document to their neighbours and each get a row; among rows of
    one id the order is by a hash of the text; a null id comes last; a lone document is
    its own next. Other columns are ignored, whatever their names. Ids are integers.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    # all three uses of the texts below need these columns and no others, so they share one shuffle
    texts = docs.select(key.alias("k"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    canon = texts.select("k", "h", F.length("text").alias("n"), canonical(F.col("text")).alias("canon"))
    hashes = written(canon.select("k", "h", "n", hash_of(F.col("canon")).alias("hash"), seeded(F.col("canon"), 3).alias("more")), "hashes")

    rows = hashes.groupBy("k", "h").agg(F.struct("k", "h", F.first("n").alias("n"), F.first("hash").alias("hash"), F.first("more").alias("more")).alias("row"))
    shared = written(hashes.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash", F.lit(True).alias("shared")), "shared")
    meta = ring(rows).select(
        "k", "h", "row.n", "row.hash", "row.more", F.col("before.k").alias("prev_k"), F.col("before.h").alias("prev_h"), F.col("before.n").alias("prev_n"),
        ((F.col("after.hash") == F.col("row.hash")) & (F.col("after.more") == F.col("row.more"))).alias("near_next"),
    )
    meta = written(meta.join(shared, "hash", "left"), "meta")

    both = texts.join(meta.hint("shuffle_hash"), ["k", "h"])
    # byte comparison: each task reduces a bucket to its smallest and largest text
    alike = both.where("shared").select("hash", canonical(F.col("text")).alias("canon")).groupBy("hash").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    mixed = alike.where("low <> high").select("hash", F.lit(True).alias("mixed"))

    third = lambda n: F.floor(n / 3).cast("int")
    lent = both.select(F.col("prev_k").alias("k"), F.col("prev_h").alias("h"), F.left("text", third(F.col("prev_n"))).alias("lent")).dropDuplicates(["k", "h"])
    edited = F.concat(F.left("text", (F.col("n") - third(F.col("n"))).cast("int")), F.col("lent"))
    own = both.join(lent, ["k", "h"]).withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited")))
    own = own.select(
        "k", F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "hash", "more",
        hash_of(F.col("edited_canon")).alias("edited_hash"), seeded(F.col("edited_canon"), 3).alias("edited_more"), "near_next",
    )
    # of n texts, n * n / 2**129 pairs are expected to collide in 128 bits, so this table is
    # mostly empty, which adaptive execution sees
    own = own.join(mixed, "hash", "left")
    own = own.join(mixed.select(F.col("hash").alias("edited_hash"), F.col("mixed").alias("edited_mixed")), "edited_hash", "left")
    name = lambda h, m, mixed: F.lower(F.concat(F.hex(h), F.when(mixed, F.concat(F.lit("-"), F.lpad(F.hex(m), 16, "0"))).otherwise("")))
    near = (F.col("hash") == F.col("edited_hash")) & (F.col("more") == F.col("edited_more"))
    return own.select(
        F.nullif(F.col("k"), F.lit(NO_ID)).cast(docs.schema[id_col].dataType).alias(id_col), "n_chars", "edited_sha256", name("hash", "more", F.col("mixed")).alias("fingerprint"),
        name("edited_hash", "edited_more", F.col("edited_mixed")).alias("edited_fingerprint"), near.cast("double").alias("near_edited"), F.col("near_next").cast("double").alias("near_next"),
    )
