"""Configurations, row types and errors of the vector engine."""

from __future__ import annotations

from dataclasses import dataclass

METADATA = "struct<timestamp: bigint, source: string, tags: array<string>, extra: map<string, string>>"


class EngineError(Exception):
    """Any error of the engine."""


class DimensionMismatch(EngineError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected {expected} dimensions, got {got}")
        self.expected, self.got = expected, got


class NodeNotFound(EngineError):
    pass


class StorageError(EngineError):
    pass


class CompressionError(EngineError):
    pass


@dataclass(frozen=True)
class SearchConfig:
    """How a search retrieves and reranks. rerank_k of 0 means ``limit``."""

    limit: int = 10
    enable_reranking: bool = True
    alpha: float = 0.7
    beta: float = 0.3
    rerank_k: int | None = None
    order_by: str = "score"  # or "d_total"
    score_mode: str = "cosine"  # or "l2"
    hops: int = 1
    degraded: bool = False

    def __post_init__(self):
        if self.limit <= 0:
            raise ValueError("limit must be above 0")
        if not (0 <= self.alpha <= 1 and 0 <= self.beta <= 1):
            raise ValueError("alpha and beta must be from 0 to 1")
        if self.order_by not in ("score", "d_total") or self.score_mode not in ("cosine", "l2"):
            raise ValueError("unknown order_by or score_mode")

    @property
    def candidates(self) -> int:
        """Candidates that are scored: half of them, but at least ``limit``, in degraded mode."""
        n = 2 * self.limit if self.rerank_k is None else self.rerank_k or self.limit
        return max(n // 2, self.limit) if self.degraded else n


@dataclass(frozen=True)
class IndexConfig:
    """A combined index of codes and a graph."""

    dimensions: int = 128
    max_neighbors: int = 16
    ef_construction: int = 200
    rabitq_bits: int = 4
    rerank_top: int = 0
    metric: str = "l2"
    seed: int = 42
    search_mode: str = "asymmetric"  # or "beam"
    beam_oversample: float = 1.5

    def __post_init__(self):
        if self.rabitq_bits not in (1, 4, 7):
            raise CompressionError(f"codes have 1, 4 or 7 bits, not {self.rabitq_bits}")
        if self.search_mode not in ("asymmetric", "beam"):
            raise ValueError("unknown search_mode")
