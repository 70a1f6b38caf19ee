"""Line deduplication with levelled sorted runs of line hashes.

The lines seen so far are kept as runs: bucketed tables of distinct line hashes,
sorted by hash in each bucket, each with the smallest document id that holds the line.
Documents come in batches of ascending ids. A batch's distinct hashes, dealt to the same
buckets, are merge-anti-joined with the runs, which are neither shuffled nor sorted for
it; what no run holds becomes a run of level 0. When a level has ``FANOUT`` runs, they
are merged bucket by bucket into one run of the next level, so a batch meets few runs
however many came before it.

A line goes if its hash is in a run of an earlier batch, or if a smaller id of its
own batch holds it.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, remove, scope, scratch, setting, text_or_empty, written

FANOUT = 2
BATCHES = 4
#: Shorter keys are never removed.
MIN_CHARS = 10
SPACES = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(SPACES).lower()


def _counts(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def line_hash(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """128 bits of the line's key; null if the key is too short to count."""
    key = line_key(line)
    return xxhash.xxh3_128_digest(key) if _counts(key, least) else None


#: Lets Spark trust the order inside a bucket that is one file.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The runs of one corpus under ``root``, a path in a shared folder.

    ``buckets`` is fixed for all runs; by default as many as the session shuffles to.
    """

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.root, self.fanout, self.made = spark, root, fanout, 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"lectern_lines_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.live: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        """A table of ``rows``, which lie in the partitions of the buckets already, by one file for each bucket."""
        table = f"{self.name}_{self.made}"
        self.made += 1
        self.live.append(table)
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{table}").bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, f"{self.root}/{table}")
        self.live.remove(table)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def drop(self) -> None:
        """Remove all runs, and what a batch that failed has left."""
        for table in [*self.live]:
            self._drop(table)
        remove(self.spark, self.root)
        self.levels = []

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch ``(id, hash)`` of ids above all earlier ones; returns the ``(id, hash)`` to remove."""
        with setting(self.spark, SORTED_BUCKETS, "true"):
            dealt = lines.groupBy("hash").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
            batch = self._write(dealt.repartition(self.buckets, "hash"))
            own = self.spark.table(batch)
            run = self._write(self.unseen(own).select("hash", "owner"))
            new = self.spark.table(run).select("hash", F.lit(True).alias("is_new"))
            known = own.hint("merge").join(new, "hash", "left").where("is_new is null or owner < last")
            repeated = written(known.select("hash", F.when(F.col("is_new"), F.col("owner")).alias("owner")), "repeated")
            self._drop(batch)
            self._push(0, run)
        gone = lines.join(repeated, "hash").where("owner is null or id > owner").select("id", "hash").distinct()
        return written(gone, "gone")

    def unseen(self, own: DataFrame) -> DataFrame:
        """The rows of ``own`` whose hash no run has."""
        for run in self.runs():
            own = own.join(run.hint("merge"), "hash", "left_anti")
        return own

    def _push(self, level: int, table: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(reduce(_merged, map(self.spark.table, self.levels[level])))
            for t in self.levels[level]:
                self._drop(t)
            self.levels[level] = []
            self._push(level + 1, merged)


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs, which share no hash, as one: a join of their buckets."""
    b = b.withColumnRenamed("owner", "other")
    return a.hint("merge").join(b, "hash", "full_outer").select("hash", F.coalesce("owner", "other").alias("owner"))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """The distinct ``(id, hash)`` of each row's lines that count."""

    def columns(b: pa.RecordBatch) -> list:
        found = [{line_hash(x, least) for x in t.split(b"\n")} - {None} for t in as_bytes(b.column(1))]
        ids = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
        return [ids, [h for x in found for h in x]]

    return map_arrow(docs, columns, "id bigint, hash binary")


def lines_to_remove(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(id, hash)`` of the lines that each document of ``(id, text)`` loses."""
    spark = docs.sparkSession
    cuts = docs.where("id is not null").agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    batch = reduce(lambda rest, k: F.when(F.col("id") <= cuts[k], k).otherwise(rest), reversed(range(len(cuts))), F.lit(len(cuts)))
    with scope(spark) as kept:
        lines = written(_lines(docs.where("id is not null"), min_chars).withColumn("batch", batch), "lines", by=["batch"])
        runs = LineRuns(spark, scratch(spark, "runs"))
        try:
            gone = [kept(runs.add(lines.where(F.col("batch") == k).select("id", "hash"))) for k in range(len(cuts) + 1)]
        finally:
            runs.drop()
    return reduce(DataFrame.unionByName, gone)


def dedup_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """Texts without the lines that a document of a smaller id has.

    Lines are the parts between line feeds; their keys are compared without ASCII white
    space at the ends and with A-Z in lower case. A key of ``min_chars`` code points or
    more stays in all its places in the smallest id that holds it and goes elsewhere.
    One row ``(id, *extra, n_lines, n_dropped, kept_text, kept_sha256)`` for each row of
    ``docs``; ``extra`` names columns to carry along, as ``extra_0``, ``extra_1``, .... Null and empty texts are one empty line, which stays; rows that repeat an
    id are one document; rows with a null id lose nothing and hold nothing against
    others; other columns are ignored, whatever their names. Ids are integers.
    """
    more = [F.col(c).alias(f"extra_{k}") for k, c in enumerate(extra or [])]
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("_text"), *more)
    gone = lines_to_remove(docs.select("id", "_text"), batches, min_chars)
    of_doc = gone.groupBy("id").agg(F.collect_list("hash").alias("hashes"))

    def columns(b: pa.RecordBatch) -> list:
        n_lines, n_dropped, kept = [], [], []
        for text, hashes in zip(as_bytes(b.column(1)), b.column(b.num_columns - 1).to_pylist()):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if hashes:
                out = set(hashes)
                lines = [x for x in lines if line_hash(x, min_chars) not in out]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(b"\n".join(lines))
        return [b.column(0), *b.columns[2:-1], n_lines, n_dropped, pa.array(kept, pa.binary()).cast(pa.string()), [hashlib.sha256(x).hexdigest() for x in kept]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text")
    schema = f"{kinds}, n_lines bigint, n_dropped bigint, kept_text string, kept_sha256 string"
    joined = docs.join(of_doc.hint("shuffle_hash"), "id", "left").select(*docs.columns, "hashes")
    return map_arrow(joined, columns, schema).withColumnRenamed("id", id_col)
