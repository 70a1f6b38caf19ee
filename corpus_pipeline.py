"""The training-data pipeline over ``documents``: five stages, each one operator of ``lectern.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before
kept. All but the last return the columns of ``documents`` (and any further columns
that ``docs`` brings), with ``text`` and ``n_chars`` as the stage leaves them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, line_dedup, mixing, near_dup, quality
from lectern.llm.common import remove, scope, written

TOKENIZER = "byte_bpe_50k.json"


def _restored(docs: DataFrame, out: DataFrame, extra: list[str], text: str) -> DataFrame:
    """The columns of ``docs`` from an operator's row, with the new text."""
    of = {c: F.col(f"extra_{k}") for k, c in enumerate(extra)} | {"text": F.col(text)}
    of |= {"doc_id": F.col([c for c in out.columns if c in ("id", "doc_id")][0]), "n_chars": F.length(text).cast("bigint")}
    return out.select(*(of[c].alias(c) for c in docs.columns))


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then the documents that lose too much or fail the base rules.

    Null and blank texts fail. Repeated rows are judged alike.
    """
    extra = _others(docs)
    return _restored(docs, quality.quality(docs, extra=extra).where("kept"), extra, "cleaned")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a smaller id holds go; a document that loses all keeps an empty text."""
    extra = _others(docs)
    return _restored(docs, line_dedup.dedup_lines(docs, extra=extra), extra, "kept_text")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more, the document of the smallest id stays.

    Rows that repeat an id are one document. Texts without words are in no group and stay.
    """
    kept = near_dup.near_duplicates(docs, 80, 100).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; of a fraction, the nearest whole number.

    Rows that repeat an id are taken equally often. Texts without words are not taken.
    """
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    mixed = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("_mixed")).agg(F.max(copies).alias("_copies")).where("_copies > 0")
    taken = docs.join(mixed.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(mixed["_mixed"]))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and digests of ids and of the text decoded from them."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: BPE cannot be expressed in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again.

    When a stage's rows are written, its own tables and the rows it read are removed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = None
    for name, stage in STAGES[:-1]:
        with scope(spark) as kept:
            docs = kept(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        if read is not None:
            remove(spark, read)
        read = docs._written_to
    return STAGES[-1][1](spark, docs, sf_dir)
