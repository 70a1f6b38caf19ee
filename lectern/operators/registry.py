"""The content registry: deduplication by content hash, reference counts, upserts and deletion.

Tables are whole DataFrames; an operator returns the new version of a table, to be
written by the caller. Deletion is an anti join, an update a join with coalesce.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import collection_name
from ..sources.tables import numbered, stored


def registry(sources: DataFrame, hash_col: str = "content_hash", order_col: str = "id", text_col: str = "text") -> DataFrame:
    """One entry for each content: that of the first source, with the number of sources.

    Partial aggregation keeps one candidate for each hash and task, so a content that
    many sources share costs no more than any other.
    """
    first = F.min_by(F.struct(F.col(text_col).alias("text")), order_col)
    grouped = sources.groupBy(F.col(hash_col).alias("content_hash")).agg(F.min(order_col).alias("first_id"), F.count("*").alias("n_refs"), first.alias("_first"))
    return grouped.select("content_hash", collection_name(F.col("content_hash")).alias("collection"), "first_id", "n_refs", F.col("_first.text").alias("extracted_text"), F.length("_first.text").alias("char_count"))


def get_or_create(entries: DataFrame, new: DataFrame, order_col: str = "id") -> DataFrame:
    """Registry rows to append: of contents not yet there, the first writer's."""
    order = Window.partitionBy("content_hash").orderBy(order_col)
    first = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.join(entries.select("content_hash"), "content_hash", "left_anti")


def orphans(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Registry entries that no source refers to."""
    return entries.join(sources.select("content_hash"), "content_hash", "left_anti")


def orphaned_by(deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """Hashes of deleted sources that no remaining source refers to."""
    return deleted.select("content_hash").distinct().join(remaining.select("content_hash"), "content_hash", "left_anti")


def reference_counts(sources: DataFrame, by: str = "notebook_id") -> DataFrame:
    """How many sources, and how many different ``by``, refer to each content."""
    per = sources.groupBy("content_hash", by).agg(F.count("*").alias("n"))
    return per.groupBy("content_hash").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_notebooks"))


def found(table: DataFrame, **equal: object) -> DataFrame:
    """Rows with these values, compared byte by byte; a filter of plain equalities that reaches the scan. None is found nowhere."""
    return reduce(lambda df, item: df.where(F.col(item[0]) == F.lit(item[1])), equal.items(), table)


def other_references(sources: DataFrame, notebook: str = "notebook_id") -> DataFrame:
    """Each source with ``here`` and ``elsewhere``: how many other sources of its notebook, and of others, have its content.

    Contents are counted with partial sums and joined, so a content that very many share is in no one task. Null contents have none.
    """
    per = stored(sources.where("content_hash is not null").groupBy("content_hash", F.col(notebook).alias("_in")).agg(F.count("*").alias("_here")), "per-notebook")
    every = stored(per.groupBy("content_hash").agg(F.sum("_here").alias("_every")), "per-content")
    joined = sources.join(per, (sources["content_hash"] == per["content_hash"]) & sources[notebook].eqNullSafe(per["_in"]), "left").drop(per["content_hash"]).drop("_in").join(every, "content_hash", "left")
    return joined.withColumn("here", F.coalesce(F.col("_here") - 1, F.lit(0))).withColumn("elsewhere", F.coalesce(F.col("_every") - F.col("_here"), F.lit(0))).drop("_here", "_every")


def seeded_admin(users: DataFrame, username: str, password_hash: str) -> DataFrame:
    """``users`` with an administrator of this name: the user there is, with role and password renewed, or a new one with the next id."""
    own = F.col("username") == username
    kept = users.withColumns({"role": F.when(own, "admin").otherwise(F.col("role")), "password_hash": F.when(own, password_hash).otherwise(F.col("password_hash"))})
    there = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"), F.coalesce(F.bool_or(own), F.lit(False)).alias("_there"))  # one row
    new = there.where("not _there").select((F.col("_last") + 1).cast(users.schema["id"].dataType).alias("id"), F.lit(username).alias("username"), F.lit("admin").alias("role"), F.lit(password_hash).alias("password_hash"))
    return kept.unionByName(new, allowMissingColumns=True)


def delete_cascade(users: DataFrame, notebooks: DataFrame, sources: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All four tables without the users of ``gone (id)`` and what belongs to them."""
    ids = gone.select(F.col("id").alias("user_id"))
    left = notebooks.join(ids, "user_id", "left_anti")
    lost = notebooks.join(ids, "user_id", "left_semi").select(F.col("id").alias("notebook_id"))
    return users.join(gone.select("id"), "id", "left_anti"), left, sources.join(lost, "notebook_id", "left_anti"), messages.join(lost, "notebook_id", "left_anti")


def updated(table: DataFrame, changes: DataFrame, key: str = "id", replace: dict[str, Column] | None = None) -> DataFrame:
    """``table`` with the non-null values of ``changes``, joined by ``key``; null means keep.

    ``replace`` overrides single columns with expressions over ``old`` and ``new``.
    """
    changed = [c for c in changes.columns if c != key]
    joined = table.alias("old").join(changes.alias("new"), key, "left")
    pick = lambda c: (replace or {}).get(c, F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) if c in changed else F.col(f"old.{c}"))
    return joined.select(*(F.col(c) if c == key else pick(c).alias(c) for c in table.columns))


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in place of those with the same key, or added."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def appended(table: DataFrame, rows: DataFrame, id_col: str = "id", order_col: str = "created_at") -> DataFrame:
    """``rows`` with ids that go on from the table's largest, in the order of ``order_col``."""
    last = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_last"))  # one row
    out = numbered(rows.drop(id_col), order_col, to="_n")
    return out.join(F.broadcast(last)).withColumn(id_col, F.col("_last") + F.col("_n")).drop("_n", "_last")


def dedup_action(has_chunks: Column, text: Column) -> Column:
    """What ingestion does with a content: use it, rebuild its chunks, drop and redo, or do all."""
    known = F.coalesce(text, F.lit("")) != ""
    return F.when(has_chunks & known, "cached").when(has_chunks, "drop_and_ingest").when(known, "rebuild").otherwise("ingest")


def source_status(text: Column, error: Column) -> Column:
    from ..functions.text import py_strip

    return F.when(error.isNotNull(), "failed").when(py_strip(F.coalesce(text, F.lit(""))) == "", "partial").otherwise("ready")
