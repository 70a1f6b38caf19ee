"""Files to searchable chunks: hash, deduplicate, parse, image-text fallback, chunk, embed, store, register."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunk, embed, generate
from ..functions.hashing import chunk_id, collection_name
from ..functions.text import py_strip
from ..sources import files as parsing
from ..sources import tables
from ..sources.config import Options
from .registry import dedup_action

NO_TEXT = "No text could be extracted from the file."


@dataclass
class Ingested:
    """``results``: a row for each file; ``chunks`` and ``entries``: rows to append, in this order."""

    results: DataFrame
    chunks: DataFrame
    entries: DataFrame


def parsed_files(files: DataFrame, options: Options = Options(), parse: Callable | None = None, image_text: Callable[[Column], Column] = generate.image_text) -> DataFrame:
    """``files`` with ``text, page_count, ocr_used, error``.

    Little text makes the text of a file's images (of a PDF, of the file) count instead,
    if there is any; ``image_text`` is a column function over bytes.
    """
    tables.bounded_batches(files.sparkSession)
    out = files.withColumn("_p", (parse or parsing.parser())("content", "content_type"))
    wanted = F.col("_p.error").isNull() & parsing.needs_ocr(F.col("_p.text"), F.col("content_type"), F.size("_p.images"), options)
    of_images = parsing.joined_image_texts(F.transform("_p.images", lambda x: image_text(x)), "Image")
    of_pages = parsing.joined_image_texts(F.array(image_text(F.col("content"))), "Page")
    found = F.when(wanted, F.when(F.col("content_type") == "pdf", of_pages).otherwise(of_images))
    used = F.coalesce(py_strip(found) != "", F.lit(False))
    return out.select(*files.columns, F.when(used, found).otherwise(F.col("_p.text")).alias("text"), F.col("_p.page_count").alias("page_count"), used.alias("ocr_used"), F.col("_p.error").alias("error"))


def ingest(files: DataFrame, entries: DataFrame, stored: DataFrame, options: Options = Options(), parse: Callable | None = None, embedding: Callable[[Column], Column] | None = None, image_text: Callable[[Column], Column] = generate.image_text) -> Ingested:
    """Ingest ``files`` (``filename, content, content_hash, content_type``) against the registry and the stored chunks.

    A content is parsed once, however many files have it, and not at all if the registry
    knows its text; it is chunked unless its chunks are stored. A file that fails is a row
    with its error. Of several files with one content the first name stands in the chunks. What is parsed is
    stored at once, without the files' bytes, so results, chunks and entries read it instead of parsing again.
    """
    have = stored.select("content_hash").distinct().withColumn("_chunks", F.lit(True))
    known = entries.select("content_hash", F.col("extracted_text").alias("_known"))
    first = files.groupBy("content_hash").agg(F.min_by(F.struct("filename", "content", "content_type"), "filename").alias("f")).select("content_hash", "f.*")
    state = first.join(have, "content_hash", "left").join(known, "content_hash", "left")
    state = state.withColumn("action", dedup_action(F.coalesce("_chunks", F.lit(False)), F.col("_known")))

    fresh = parsed_files(state.where(F.col("action").isin("ingest", "drop_and_ingest")).drop("_known", "_chunks"), options, parse, image_text)
    fresh = tables.stored(fresh.drop("content", "content_type"), "parsed")
    again = state.where(F.col("action").isin("cached", "rebuild")).drop("_chunks", "content", "content_type").withColumnRenamed("_known", "text")
    again = again.withColumns({"page_count": F.lit(None).cast("int"), "ocr_used": F.lit(False), "error": F.lit(None).cast("string")})
    done = fresh.unionByName(again)
    blank = py_strip(F.coalesce("text", F.lit(""))) == ""
    status = F.when(F.col("error").isNotNull(), "failed").when(blank, "partial").otherwise("ready")
    message = F.coalesce("error", F.when(blank, NO_TEXT))
    done = done.withColumn("status", status).withColumn("error_message", message)

    ready = done.where("status = 'ready'")
    cut = chunk.chunks(ready.where("action <> 'cached'"), F.col("text"), "content_hash", "filename")
    cut = chunk.dealt(cut, F.substring("content_hash", 1, 2))  # as they are stored
    vector = (embedding or embed.embedder(dimension=options.embedding_dimension))(F.col("document"))
    chunks = cut.select(chunk_id(F.col("content_hash"), F.col("chunk_index")).alias("id"), "content_hash", "chunk_index", "page", "filename", "document", vector.alias("embedding"))
    new = ready.where(F.col("action").isin("ingest", "drop_and_ingest"))
    new = new.select("content_hash", collection_name(F.col("content_hash")).alias("collection"), F.col("text").alias("extracted_text"), F.length("text").alias("char_count"))
    outcome = done.select("content_hash", "action", "status", "page_count", "ocr_used", "error_message", F.when(F.col("status") == "ready", F.length("text")).otherwise(0).alias("char_count"))
    return Ingested(files.select("filename", "content_hash").join(outcome, "content_hash"), chunks, new)


def store(made: Ingested, chunks_path: str, entries_path: str) -> None:
    """Append chunks, then registry entries: the registry is the commit record.

    A failure between the two leaves chunks without an entry; ``orphan_chunks`` finds them.
    Chunks lie by the first two digits of their hash, so a collection is in one folder.
    """
    made.chunks.withColumn("prefix", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(chunks_path)
    made.entries.write.mode("append").parquet(entries_path)


def orphan_chunks(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks whose content has no registry entry."""
    return stored.join(entries.select("content_hash"), "content_hash", "left_anti")
