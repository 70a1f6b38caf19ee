"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources share a budget of words by weight; no source gives more than ``max_epochs``
times its size. Sources above that are clamped and the excess goes to the others by
weight, until none is above. Each source is then taken in whole repetitions of all
its documents and one fractional repetition: documents in the order of a seeded hash
up to the target, of which the last one gives only the words still missing.

The running sum of a source does not need its documents in one task: the hash splits
a source into about the square root of its documents buckets; bucket sums run over
buckets, and documents only over their own bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, written

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def water_fill(sources: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """Add ``target`` (double) to ``(source, weight, source_size)``.

    Rounds clamp the sources whose share is above their cap; only sums come to the
    driver. Weights are positive integers, so the sums are exact.
    """
    cap = F.col("source_size") * max_epochs
    capped = F.lit(False)
    clamped = -1
    while True:
        row = sources.agg(
            F.sum(F.when(capped, 1).otherwise(0)).alias("n"), F.sum(F.when(capped, cap).otherwise(0)).alias("caps"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weights")
        ).first()
        if row.n is None or row.n == clamped:
            break
        clamped, left, weights = row.n, budget - row.caps, row.weights
        # cap < weight * left / weights, exactly; the share of a weight only grows, so who is above once stays above
        capped = cap.cast("decimal(38,0)") * F.lit(weights).cast("decimal(20,0)") < F.col("weight").cast("decimal(20,0)") * F.lit(left).cast("decimal(20,0)")
    if row.n is None:
        return sources.withColumn("target", F.lit(0.0))
    share = F.col("weight").cast("double") * float(left) / float(weights) if weights else F.lit(0.0)
    return sources.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, budget: int | None = None, max_epochs: int = 3, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of each document.

    ``weights`` has ``(source, weight)`` with positive integers; by default sources
    weigh 1, 2, 3, repeating, by code point, null last. ``budget`` defaults to all
    words. One row ``(id, size, source_size, target, taken)`` for each row of ``docs``:
    words of the text (null or blank: 0), of its source, the source's target and the
    words taken, repeats counted, at most ``max_epochs`` times the size. A null source is
    a source of its own; a source without words has target 0; a source missing from
    ``weights`` is left out of the mix (target 0). Repeated rows are taken like other
    rows, each on its own; other columns are ignored, whatever their names. Reruns
    agree, however the rows are dealt to tasks.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))
    # the key stands for the source where null must equal null; \x01 is no other source's first character by then
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("~"))
    rows = docs.select(F.col(id_col).alias("_id"), key.alias("_source"), size.alias("size"), order.alias("_order"))
    rows = written(rows, "sizes")
    sources = written(rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs")), "sources")
    if weights is None:
        sources = ranked(sources, (F.col("_source") == "~").asc(), F.col("_source").asc(), to="weight")
        sources = sources.withColumn("weight", ((F.col("weight") - 1) % 3 + 1).cast("bigint"))
    else:
        given = weights.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~")).alias("_source"), F.col("weight").cast("bigint"))
        sources = sources.join(given, "_source", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    sources = written(sources, "weighted")
    used = sources.where("weight > 0")
    if budget is None:
        budget = used.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(used, budget, max_epochs)
    plan = sources.join(plan.select("_source", "target"), "_source", "left").fillna(0.0, ["target"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = plan.withColumn("_whole", F.least(whole, F.lit(max_epochs))).withColumn("_part", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("bigint"))
    # the first 24 bits of the hash deal a source's documents to buckets, about its root of each
    plan = written(plan.withColumn("_step", F.ceil(F.lit(1 << 24) / F.sqrt("_docs")).cast("bigint")).select("_source", "source_size", "target", "_whole", "_part", "_step"), "plan")

    dealt = rows.join(plan, "_source").withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 6), 16, 10).cast("bigint") / F.col("_step")))
    dealt = written(dealt, "dealt")
    sums = dealt.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    inside = F.sum("size").over(Window.partitionBy("_source", "_bucket").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    start = F.col("_before") + inside
    fraction = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_part") - start))
    return dealt.join(sums, ["_source", "_bucket"]).select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("_whole") + fraction).cast("bigint").alias("taken"))
