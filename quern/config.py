"""Validated settings. Every knob that changes results is here, with its range."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be within {low} and {high}, not {value}")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value}")


@dataclass(frozen=True)
class Chunking:
    """Sizes in estimated tokens."""

    child_chunk_size: int = 360
    child_chunk_overlap: int = 60
    parent_chunk_size: int = 1600

    def __post_init__(self) -> None:
        _within("child_chunk_size", self.child_chunk_size, 50, 4000)
        _within("child_chunk_overlap", self.child_chunk_overlap, 0, 1000)
        _within("parent_chunk_size", self.parent_chunk_size, 100, 16000)
        if not self.child_chunk_overlap < self.child_chunk_size <= self.parent_chunk_size:
            raise ValueError("overlap < child size <= parent size must hold")

    def fingerprint(self, version: str) -> str:
        """Changes whenever piece boundaries could change."""
        return hashlib.sha256(json.dumps({"version": version, **asdict(self)}, sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Embedding:
    model: str = "hash-embed"
    dim: int = 384
    query_prefix: str = ""
    include_context: bool = True

    def __post_init__(self) -> None:
        _within("dim", self.dim, 8, 4096)


@dataclass(frozen=True)
class Retrieval:
    strategy: str = "baseline"
    top_k: int = 10
    metric: str = "cosine"
    fusion: str = "linear"
    dense_weight: float = 0.5
    bm25_weight: float = 0.5
    rrf_k: int = 60
    candidates: int = 50
    k1: float = 1.2
    b: float = 0.75
    include_context: bool = True
    compounds: bool = True
    camel_parts: bool = False
    stemming: bool = False
    rerank_candidates: int = 20
    rerank_top_k: int = 5

    def __post_init__(self) -> None:
        _one_of("metric", self.metric, ("cosine", "l2", "inner_product"))
        _one_of("fusion", self.fusion, ("rrf", "linear"))
        for name, low, high in (("top_k", 1, 200), ("candidates", 1, 1000), ("k1", 0, 5), ("b", 0, 1), ("rerank_candidates", 1, 500), ("rerank_top_k", 1, 100), ("rrf_k", 1, 10**9)):
            _within(name, getattr(self, name), low, high)
        if min(self.dense_weight, self.bm25_weight) < 0 or self.dense_weight + self.bm25_weight <= 0:
            raise ValueError("weights must not be negative and must not all be zero")
        if not self.rerank_top_k <= self.rerank_candidates <= self.candidates:
            raise ValueError("rerank_top_k <= rerank_candidates <= candidates must hold")


@dataclass(frozen=True)
class Generation:
    provider: str = "offline"
    model: str = "offline"
    temperature: float = 0.0
    max_tokens: int = 512
    timeout_s: float = 60.0
    retries: int = 3
    pricing: dict[str, tuple[float, float]] = field(default_factory=dict)
    local_models: frozenset[str] = frozenset({"offline"})

    def __post_init__(self) -> None:
        _within("temperature", self.temperature, 0, 2)
        _within("max_tokens", self.max_tokens, 16, 32000)
        _within("retries", self.retries, 0, 10)


@dataclass(frozen=True)
class Adaptive:
    """Thresholds and loop caps of adaptive strategies; validated, used by no strategy yet."""

    relevance: float = 0.5
    support: float = 0.5
    usefulness: float = 0.5
    max_rewrites: int = 2
    max_corrections: int = 2
    max_reflections: int = 1

    def __post_init__(self) -> None:
        for name in ("relevance", "support", "usefulness"):
            _within(name, getattr(self, name), 0, 1)
        for name, high in (("max_rewrites", 5), ("max_corrections", 5), ("max_reflections", 3)):
            _within(name, getattr(self, name), 0, high)


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    adaptive: Adaptive = field(default_factory=Adaptive)

    def snapshot(self) -> dict:
        """All settings as plain values, for reports. There are no secrets among them."""
        out = asdict(self)
        out["generation"]["local_models"] = sorted(self.generation.local_models)
        return out
