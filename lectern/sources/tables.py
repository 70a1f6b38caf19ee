"""Intermediate tables in the folder that all executors share, rows over cores, and numbering over ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster has no
    folder that would do, so that is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    held = getattr(spark, "_lectern_dir", None)
    if held is None:
        held = spark._lectern_dir = tempfile.mkdtemp(prefix="lectern-")
    return held


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under this application's own name."""
    return f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs a read.

    The scope that is open where this is called, if any, removes the table at its end.
    """
    path = workspace(df.sparkSession, name)
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


#: Paths that the innermost scope has written. Each thread and task has scopes of its own.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove, at the end, what ``stored`` wrote inside, but for the tables handed to the function given.

    Those pass to the scope around, if there is one; after a failure, none is kept. No table that a lazy frame still reads may be left out.
    """
    own: list[str] = []
    kept: list[DataFrame] = []
    token = _SCOPE.set(own)
    try:
        yield lambda df: kept.append(df) or df
    except BaseException:
        kept.clear()  # nobody gets them
        raise
    finally:
        _SCOPE.reset(token)
        stay = [df._written_to for df in kept]
        if (around := _SCOPE.get()) is not None:
            around.extend(stay)
        for path in own:
            if path not in stay:
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch that a Python function gets at once; a longer row stands alone.
BATCH_BYTES = 1 << 22
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches in this session hold ``BATCH_BYTES`` at most, or less if the session says so.

    A worker holds several times a batch: as Arrow, as Python objects, and what it makes of them. With Spark's bound on
    rows and its 64 MB, that grows with the length of rows and the share of a partition that a batch is. Only rows that are
    long are fewer in a batch by this.
    """
    if int(spark.conf.get(_BYTES_KEY).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BYTES_KEY, f"{BATCH_BYTES}b")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores: for work by row that outweighs reading the row.

    A table of few bytes is few splits, however many rows it has, and the work on them would be as few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def running_sums(df: DataFrame, by: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """``df`` with ``to``: the sum of ``value`` up to the row within its ``by``, in ``order``, without all rows of a key in one task.

    Rows are dealt to ranges and summed inside them; of the ranges before, only sums go along. Null keys are one key.
    """
    dealt = stored(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = sums.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(own), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    here = reduce(Column.__and__, (dealt[c].eqNullSafe(before[f"_by{k}"]) for k, c in enumerate(by)), dealt["_part"] == before["_at"])
    return dealt.withColumn(to, inside).join(before, here).withColumn(to, F.col(to) + F.col("_before")).select(*df.columns, to)


def numbered(df: DataFrame, *order: Column | str, to: str) -> DataFrame:
    """Each row's place from 1 in the order, without all rows in one task.

    Rows are dealt to ranges and numbered inside them; only the sizes of the ranges, a
    row for each partition, meet in one task.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(to, F.col("_before") + place).drop("_part", "_before")
