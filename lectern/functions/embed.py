"""Embeddings: a deterministic hash embedder, and the plug for real models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 1024


def hash_vector(text: str, dimension: int = DIMENSION, query: bool = False) -> np.ndarray:
    """Unit vector from chained SHA-256 blocks; queries and documents are salted differently."""
    seed = hashlib.sha256((b"query" if query else b"document") + text.encode()).digest()
    blocks = b"".join(hashlib.sha256(seed + i.to_bytes(4, "big")).digest() for i in range(-(-dimension // 32)))
    raw = np.frombuffer(blocks, dtype=np.uint8)[:dimension] / 255.0 - 0.5
    norm = np.sqrt((raw**2).sum())
    return raw / (norm or 1.0)


def embedder(model: Callable[[], Callable[[list[str]], list]] | None = None, dimension: int = DIMENSION, query: bool = False) -> Callable[[Column], Column]:
    """A column function that embeds texts; null and empty texts have no vector.

    ``model`` makes the encoder once for each task; of vectors for each token it gives, the last one counts. Without it the hash embedder serves.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model() if model else lambda texts: [hash_vector(t, dimension, query) for t in texts]
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            some = texts.notna() & (texts != "")
            for k, v in zip(out.index[some], encode(texts[some].tolist())):
                out[k] = np.atleast_1d(last_token(v)).astype(np.float32)
            yield out

    return embed


def last_token(output: object) -> np.ndarray:
    """One vector from a model's output of shape (1, tokens, dim), (tokens, dim) or (dim)."""
    a = np.squeeze(np.asarray(output, dtype=float))
    return a[-1] if a.ndim > 1 else a
