"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokens), partitioned by tokenizer digest,
so that a call reads its own tokenizer's counts only; ``compact`` merges its appends. A
document's digest is that of its normalised content: runs of ASCII white space as one
space, which the tokenizers concerned drop or read alike. Documents are joined to the
cache by both digests; of the misses, one document for each distinct digest is
encoded and its count appended. The tokenizer digest is that of the tokenizer's file
and settings, so another version never meets old counts.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, scratch, slices, text_or_empty, written

CACHE_SCHEMA = "digest binary, n_tokens bigint, tokenizer string"
#: Words that a worker keeps counted; beyond that, a word is counted for its batch alone.
CACHE_WORDS = 500_000


class WordCounter:
    """Counts the tokens of texts with a tokenizer that drops white space (JSON of the ``tokenizers`` library).

    White space ends every token of such a tokenizer and normalisation does not reach
    across it, so a text has as many tokens as its words together, and only words not
    seen before are encoded. Special strings hold no white space, so they are found
    inside words as the library finds them by default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.encode.no_truncation()
        self.encode.no_padding()
        self.known: dict[bytes, int] = {b"": 0}

    def counts(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]  # of bytes: at ASCII white space
        missing = [w for w in set().union(*split) if w not in self.known]
        found = self.encode.encode_batch_fast([w.decode("utf-8", "replace") for w in missing], add_special_tokens=False)
        if len(self.known) < CACHE_WORDS:
            known = self.known
            known.update(zip(missing, map(len, found)))
        else:
            known = dict(zip(missing, map(len, found)))
            return [sum(known[w] if w in known else self.known[w] for w in ws) for ws in split]
        return [sum(map(known.__getitem__, ws)) for ws in split]


class PieceCounter:
    """Counts the tokens of whole texts with a sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[bytes]) -> list[int]:
        return [len(x) for x in self.model.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)]


class TextCounter:
    """Counts the tokens of whole texts with any tokenizer of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.encode.no_truncation()
        self.encode.no_padding()

    def counts(self, texts: list[bytes]) -> list[int]:
        return [len(x) for x in self.encode.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]


@functools.cache
def drops_white_space(path: str) -> bool:
    """Whether the tokenizer splits at white space and drops it before merging.

    Asked of the tokenizer itself: no white space may reach its tokens, and words
    apart must have as many tokens as the words alone.
    """
    if path.endswith(".model"):
        return False
    whole = TextCounter(path)
    words = ["a", "Ab", "it's", "x1.y", "--", "é", "'", "s", "12"]
    alone = whole.counts([w.encode() for w in words])
    pairs = [(i, j, s) for i in range(len(words)) for j in range(len(words)) for s in (" ", "\n", " \t\r\n ")]
    return whole.counts([f"{s}{words[i]}{s}{words[j]}{s}".encode() for i, j, s in pairs]) == [alone[i] + alone[j] for i, j, _ in pairs]


def counter_for(path: str) -> type:
    return PieceCounter if path.endswith(".model") else WordCounter if drops_white_space(path) else TextCounter


_held: dict[str, object] = {}


def _counter(path: str, kind: Callable):
    if path not in _held:
        _held[path] = kind(path)
    return _held[path]


def tokenizer_digest(path: str, kind: type) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens|" + kind.__name__.encode()).hexdigest()


def compact(spark: SparkSession, cache: str, to: str) -> None:
    """Write the cache to a new path with each count once, in few files."""
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy("tokenizer", "digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts.select("digest", "n_tokens", "tokenizer").write.partitionBy("tokenizer").parquet(to)


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each text, without begin, end or other added tokens.

    ``cache`` is the path of the cache table, in a folder that all executors share; it is
    made if absent and appended to. Without it, a fresh one serves this call. One row
    ``(id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``. Null and empty texts
    have no bytes and no tokens; repeated rows and equal texts are encoded once and each
    get a row; a null id stays null; other columns are ignored, whatever their names.
    Two jobs that append at once may store a count twice, which changes nothing.
    """
    spark = docs.sparkSession
    kind = counter_for(path)
    own = tokenizer_digest(path, kind)
    text = text_or_empty(text_col)
    content = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if kind is WordCounter else text
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.sha2(content, 256)).alias("digest"))

    cache = cache or scratch(spark, "token-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(own)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    keys = written(rows.select("_id", "digest", F.octet_length("_text").cast("bigint").alias("n_bytes")), "keys")
    # one document stands for each distinct miss; texts are shuffled by document, not by digest
    miss = keys.groupBy("digest").agg(F.min("_id").alias("_id")).join(stored(), "digest", "left_anti")
    miss = miss.select(F.col("_id").alias("miss_id"), F.col("digest").alias("miss_digest"))
    todo = rows.join(miss.hint("shuffle_hash"), rows["_id"].eqNullSafe(miss["miss_id"]) & (rows["digest"] == miss["miss_digest"]), "left_semi").select("digest", "_text")

    def columns(b: pa.RecordBatch) -> list:
        texts, counter = as_bytes(b.column(1)), _counter(path, kind)
        n = [k for i, j in slices(texts) for k in counter.counts(texts[i:j])]
        return [b.column(0), n, [own] * len(texts)]

    counted = map_arrow(todo, columns, CACHE_SCHEMA).groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).select("digest", "n_tokens", "tokenizer")
    counted.write.mode("append").partitionBy("tokenizer").parquet(cache)
    # from a table of its own, the join's sides are plain exchanges, of which Spark splits a hot digest's
    counted = keys.join(written(stored(), "counts"), "digest")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
