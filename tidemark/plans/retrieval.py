"""One search over a corpus: legs, fusion, parents, reranking, top k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import BM25, KbConfig, SearchConfig
from tidemark.functions.text import tokenize
from tidemark.operators import search
from tidemark.plans.corpus import Corpus

COLUMNS = (
    "query_id", "rank", "kb_id", "parent_id", "score", "child_id", "matched_text", "content", "source",
)


def retrieve(
    queries: DataFrame,
    corpus: Corpus,
    base: KbConfig = KbConfig(),
    config: SearchConfig = SearchConfig(),
    embed_queries: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    hypotheses: DataFrame | None = None,
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    tokens=tokenize,
) -> DataFrame:
    """Up to `top_k` parents per query, best first.

    A single index ranks parents by its own score; several are fused by rank, each cut to
    `prefetch` children first. `embed_queries` adds `embedding` for `text`. A base with late
    interaction reranks by its stored token vectors, another by the built-in lexical scorer;
    `rerank(hits, queries)` replaces either. Reranking goes by the question as asked.
    """
    config.check_against(base)
    asked = search.search_text(queries, hypotheses if config.hyde else None)
    single = len(config.indexes) == 1
    limit = config.pool if single else config.prefetch
    legs = []
    for name in config.indexes:
        if name == BM25:
            legs.append(search.sparse_search(asked, corpus.terms, corpus.idf, limit, single, tokens))
        else:
            vectors = embed_queries[name](asked)
            legs.append(search.dense_search(vectors, corpus.dense[name], limit, per_parent=single))
    hits = legs[0]
    if not single:
        fused = search.fuse(legs, config.prefetch, config.rrf_k)
        hits = search.collapse_parents(fused, config.pool)
    full = search.hydrate(hits, corpus.parents, corpus.children)
    if config.rerank_on and rerank is not None:
        full = rerank(full, asked)
    elif config.rerank_on and base.reranker_type == "late-interaction":
        original = asked.withColumn("text", F.col("asked"))
        vectors = embed_queries[base.reranker_model_id](original)
        query_tokens = vectors.select("query_id", F.col("embedding").alias("vectors"))
        full = search.maxsim_rerank(full, query_tokens, corpus.tokens, config.rerank_on)
    elif config.rerank_on:
        full = search.rerank(full, asked, config.rerank_on)
    return full.where(F.col("rank") <= config.top_k).select(*COLUMNS)
