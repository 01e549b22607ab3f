"""Settings, from defaults or the environment (``SILTSTONE_<GROUP>_<NAME>``)."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 10
    max_top_k: int = 100
    min_score: float = 0.0
    rrf_k: int = 60
    vector_weight: float = 1.0
    bm25_weight: float = 1.0
    rerank: bool = False
    k1: float = 1.5
    b: float = 0.75

    def candidates(self, top_k: int | None = None) -> int:
        """How many rows each leg brings to the fusion."""
        return max(4 * (top_k or self.top_k), 50)


@dataclass(frozen=True)
class CodecConfig:
    enabled: bool = False
    shadow: bool = False
    bits: int = 8
    seed: int = 42
    pool: int = 200

    @property
    def active(self) -> bool:
        return self.enabled or self.shadow


@dataclass(frozen=True)
class DocumentConfig:
    max_file_mb: float = 20.0
    max_text_chars: int = 100_000
    overlap_tokens: int = 32
    min_tokens: int = 20
    max_input_chars: int = 300_000
    parser: str = "builtin"
    pages_per_range: int = 25


@dataclass(frozen=True)
class EmbeddingConfig:
    provider: str = "hashing"
    dimension: int = 64
    max_input_tokens: int = 256


@dataclass(frozen=True)
class Settings:
    search: SearchConfig = field(default_factory=SearchConfig)
    codec: CodecConfig = field(default_factory=CodecConfig)
    document: DocumentConfig = field(default_factory=DocumentConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)


def from_environment(env: dict[str, str] | None = None) -> Settings:
    env = dict(os.environ) if env is None else env

    def group(cls, name: str):
        found = {}
        for f in fields(cls):
            raw = env.get(f"SILTSTONE_{name}_{f.name}".upper())
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**found)

    return Settings(group(SearchConfig, "search"), group(CodecConfig, "codec"), group(DocumentConfig, "document"), group(EmbeddingConfig, "embedding"))
