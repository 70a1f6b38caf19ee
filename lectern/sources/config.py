"""Options of the engine, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    embedding_dimension: int = 1024
    top_k: int = 5
    top_k_per_collection: int = 3
    context_chars: int = 30_000
    max_sources_per_notebook: int = 50
    max_file_size_mb: int = 25
    voice_max_mb: int = 10
    voice_max_seconds: int = 60
    ocr_enabled: bool = True
    ocr_threshold_chars: int = 200
    chat_history: int = 100
    script_min_seconds: int = 60
    script_max_seconds: int = 480

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "LECTERN_") -> Options:
        """Values of ``LECTERN_*``; what does not parse keeps its default."""
        found: dict[str, object] = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            if isinstance(f.default, bool):
                found[f.name] = raw.strip().lower() in ("true", "1", "yes")
            else:
                try:
                    found[f.name] = int(raw)
                except ValueError:
                    continue
        return cls(**found)
