"""Settings of an engine, within their bounds."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields


def _clamped(low, high):
    return lambda v: min(max(v, low), high)


_BOUNDS = {
    "candidate_limit": _clamped(40, 2000),
    "max_output_items": _clamped(1, 100),
    "max_output_tokens": lambda v: max(v, 1000),
    "query_model_max_chars": lambda v: max(v, 512),
    "vector_min_similarity": _clamped(-1.0, 1.0),
    "vector_only_min_similarity": _clamped(-1.0, 1.0),
    "search_concurrency": _clamped(1, 256),
    "add_concurrency": _clamped(1, 256),
}


@dataclass(frozen=True)
class EngineConfig:
    """Numbers are pulled into their bounds; models are Python callables, None for none."""

    candidate_limit: int = 300
    max_output_tokens: int = 32_000
    max_output_items: int = 100
    query_model_max_chars: int = 16_000
    vector_min_similarity: float = 0.35
    vector_only_min_similarity: float = 0.65
    search_concurrency: int = 32
    add_concurrency: int = 16
    stats_scope: str = "corpus"
    lexical_backend: str = "bm25"
    tokenizer: str = "porter"
    exact_unicode: bool = False
    embedding_model: str = "mock-64"
    embeddings: bool = True
    cache_entries: int = 512
    embedder: Callable | None = None
    annotator: Callable | None = None
    analyzer: Callable | None = None
    reranker: Callable | None = None

    def __post_init__(self):
        for name, bound in _BOUNDS.items():
            object.__setattr__(self, name, bound(getattr(self, name)))
        for name, known in (("stats_scope", ("corpus", "user")), ("lexical_backend", ("bm25", "prefix")), ("tokenizer", ("plain", "porter"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "GLEANER_") -> EngineConfig:
        """Settings from GLEANER_<NAME>; what does not parse keeps its default."""
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None or f.default is None:
                continue
            try:
                given[f.name] = raw.strip().lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(raw)
            except ValueError:
                continue
        return cls(**given)

    def cache_part(self) -> tuple:
        """What a cached result depends on."""
        return tuple(getattr(self, f.name) for f in fields(self) if not callable(getattr(self, f.name)))
