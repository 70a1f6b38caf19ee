"""Context for questions and scripts: budgeted selection, context strings, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import USABLE
from ..sources.tables import running_sums, stored


def usable(status: Column) -> Column:
    return status.isin(*USABLE)


def within_budget(texts: DataFrame, max_chars: int = 30_000, notebook: str = "notebook_id", order: str = "id", text: str = "text") -> DataFrame:
    """The first texts of each notebook that fit the budget, with ``running`` characters.

    Texts count in order until one would exceed the budget; the first always counts; empty ones do not. A notebook of
    many texts is summed over ranges, in as many tasks as it fills.
    """
    sized = stored(texts.where(F.length(text) > 0).select(notebook, order, F.length(text).alias("chars")), "sized")
    summed = running_sums(sized, [notebook], [order], "chars", "running")
    return summed.where((F.col("running") == F.col("chars")) | (F.col("running") <= max_chars))


def budget_summary(texts: DataFrame, max_chars: int = 30_000, notebook: str = "notebook_id", order: str = "id", text: str = "text") -> DataFrame:
    """Characters and number of the chosen texts, and the number available, of each notebook."""
    chosen = within_budget(texts, max_chars, notebook, order, text).groupBy(notebook).agg(F.sum("chars").alias("total_chars"), F.count("*").alias("used_count"))
    return texts.where(F.length(text) > 0).groupBy(notebook).agg(F.count("*").alias("total_count")).join(chosen, notebook)


def context_strings(hits: DataFrame) -> DataFrame:
    """One context for each question: its hits by rank under numbered headers."""
    header = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] ("), "filename", F.coalesce(F.concat(F.lit(", Page "), F.col("page").cast("string")), F.lit("")), F.lit(")\n"))
    part = F.struct("rank", F.concat(header, "text").alias("part"))
    return hits.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), "\n\n").alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    """The distinct file and page of each question's hits, in the order of their best rank."""
    return hits.groupBy("question_id", "filename", "page").agg(F.min("rank").alias("rank"))
