"""Settings of a knowledge base and of one search, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

# The names and defaults a caller may rely on.
CHUNKING_METHODS = ("fix-sized", "recursive", "semantic")
RERANKER_TYPES = ("cross-encoder", "late-interaction")
RERANK_TARGETS = ("parent", "child")
CATEGORIES = ("simple", "reasoning", "multi_context", "conditional")
METRICS = ("context_precision", "context_recall", "hit_rate", "mrr")
CHILD_SIZE = 512
CHILD_OVERLAP = 40
PARENT_SIZE = 1024
MIN_PARENT_SIZE = 256
BM25 = "bm25"


def _positive(name: str, value: int | None) -> None:
    if value is not None and value <= 0:
        raise ValueError(f"{name} must be greater than 0, got {value}")


@dataclass(frozen=True)
class KbConfig:
    """How a base is chunked and indexed. `indexes` holds "bm25" and/or model ids."""

    chunking_method: str = "recursive"
    chunking_model_id: str | None = None
    max_chunk_size: int = PARENT_SIZE
    min_chunk_size: int = MIN_PARENT_SIZE
    indexes: tuple[str, ...] = (BM25,)
    reranker_type: str | None = None
    reranker_model_id: str | None = None
    hyde_model_id: str | None = None

    def __post_init__(self) -> None:
        if self.chunking_method not in CHUNKING_METHODS:
            raise ValueError(f"unknown chunking method {self.chunking_method!r}")
        _positive("max_chunk_size", self.max_chunk_size)
        _positive("min_chunk_size", self.min_chunk_size)
        if self.min_chunk_size >= self.max_chunk_size:
            raise ValueError("min_chunk_size must be smaller than max_chunk_size")
        if self.chunking_method == "semantic" and not self.chunking_model_id:
            raise ValueError("semantic chunking needs a chunking_model_id")
        if not self.indexes or not all(self.indexes):
            raise ValueError("at least one named index is needed")
        if self.reranker_type is not None:
            if self.reranker_type not in RERANKER_TYPES:
                raise ValueError(f"unknown reranker type {self.reranker_type!r}")
            if not self.reranker_model_id:
                raise ValueError("a reranker needs a model id")
        if self.hyde_model_id == "":
            raise ValueError("hyde_model_id may not be empty")


@dataclass(frozen=True)
class SearchConfig:
    """One search. Unset limits follow from the others: pool = top_k, prefetch = 2 x pool."""

    indexes: tuple[str, ...] = (BM25,)
    top_k: int = 5
    rerank_on: str | None = None
    rerank_pool: int | None = None
    prefetch_limit: int | None = None
    hyde: bool = False
    rrf_k: int = 60
    pool: int = field(init=False)
    prefetch: int = field(init=False)

    def __post_init__(self) -> None:
        if not self.indexes or not all(self.indexes):
            raise ValueError("a search needs at least one named index")
        _positive("top_k", self.top_k)
        _positive("rerank_pool", self.rerank_pool)
        _positive("prefetch_limit", self.prefetch_limit)
        if self.rerank_on is not None and self.rerank_on not in RERANK_TARGETS:
            raise ValueError(f"rerank_on must be one of {RERANK_TARGETS}")
        pool = self.rerank_pool or self.top_k
        object.__setattr__(self, "pool", pool)
        object.__setattr__(self, "prefetch", self.prefetch_limit or 2 * pool)

    def check_against(self, base: KbConfig) -> None:
        """Refuse, before any work starts, what the base cannot serve."""
        missing = set(self.indexes) - set(base.indexes)
        if missing:
            raise ValueError(f"indexes not available in this base: {sorted(missing)}")
        if self.rerank_on and base.reranker_type is None:
            raise ValueError("this base has no reranker")
        if self.hyde and base.hyde_model_id is None:
            raise ValueError("this base has no HyDE model")
