"""From documents to index tables, and the tables a search reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import BM25, KbConfig
from tidemark.functions.text import tokenize
from tidemark.operators import chunking, index
from tidemark.plans.skew import materialize


@dataclass(frozen=True)
class Corpus:
    """Index tables of any number of bases; `dense` maps a model id to its vectors.

    `tokens` holds a row per chunk with its token vectors, for late interaction. `failed` lists
    the files that could not be indexed and are in none of the tables: kb_id, doc_id, stage, error.
    """

    parents: DataFrame
    children: DataFrame
    terms: DataFrame | None
    idf: DataFrame | None
    dense: dict[str, DataFrame]
    tokens: DataFrame | None = None
    failed: DataFrame | None = None


ERROR = "error"  # the column an embedder may add, see hooks.embedded


def _failures(chunks: DataFrame, stage: str, order: list[str]) -> DataFrame | None:
    """The first failed chunk of every file, if the stage tells failures at all."""
    if ERROR not in chunks.columns:
        return None
    first = F.min_by(ERROR, F.struct(*order)).alias("error")
    return chunks.where(F.col(ERROR).isNotNull()).groupBy("kb_id", "doc_id").agg(first).select("kb_id", "doc_id", F.lit(stage).alias("stage"), "error")


def _without(table: DataFrame | None, failed: DataFrame) -> DataFrame | None:
    """Rows of files that did not fail."""
    return None if table is None else table.join(failed, ["kb_id", "doc_id"], "left_anti")


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Written and read back; texts, words and counts take a third less room with zstd."""
    return materialize(rows, name, "zstd")


def build_corpus(
    documents: DataFrame,
    config: KbConfig = KbConfig(),
    embedders: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    tokens: Callable[[Column], Column] = tokenize,
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> Corpus:
    """Chunk and index documents(kb_id, doc_id, source, text).

    `embedders` maps a model id to a function that adds `embedding` for the column `content`
    (or `context`, for semantic chunking; one vector per token for late interaction). Chunks and terms are written once, because
    several later steps read each of them.

    An embedder may tell failures in a column `error` instead of raising. A file with a chunk that
    failed is then left out of all tables and listed in `failed` with the stage and message of its
    first failure; all other files are indexed.

    `keep` writes a table, given its name in a stored index, and reads it back.
    """
    embedders, keep = embedders or {}, keep or _packed
    told: list[DataFrame] = []
    if config.chunking_method == "semantic":
        parents, failures = _semantic_parents(documents, config, embedders[config.chunking_model_id])
        told += [failures] if failures is not None else []
    else:
        parents = _parents(documents, config)
    parents = keep(parents, "parents")
    children = keep(chunking.chunk_children(parents), "children")
    terms = idf = None
    if BM25 in config.indexes:
        terms = keep(index.child_terms(children, tokens), "terms")
        idf = keep(index.term_idf(terms), "idf")
    seqs = parents.select("kb_id", "parent_id", F.col("seq").alias("_parent_seq"))
    dense = {}
    models = sorted(set(config.indexes) - {BM25})
    for model in config.indexes:
        if model != BM25:
            made = embedders[model](children)
            kept = ["kb_id", "doc_id", "parent_id", "child_id", "embedding", *(["seq", ERROR] if ERROR in made.columns else [])]
            dense[model] = keep(made.select(*kept), f"dense-{models.index(model)}")
            if ERROR in made.columns:
                bad = dense[model].where(F.col(ERROR).isNotNull()).join(seqs, ["kb_id", "parent_id"])
                told.append(_failures(bad, model, ["_parent_seq", "seq"]))
    vectors = None
    if config.reranker_type == "late-interaction":
        vectors = keep(_token_vectors(parents, children, embedders[config.reranker_model_id]), "token_vectors")
        if ERROR in vectors.columns:
            told.append(_failures(vectors, config.reranker_model_id, ["is_parent", "chunk_id"]))
    failed = None
    if told:
        every = told[0]
        for more in told[1:]:
            every = every.unionByName(more)
        failed = materialize(every.groupBy("kb_id", "doc_id").agg(F.min(F.struct("stage", "error")).alias("_first")).select("kb_id", "doc_id", "_first.*"), "failed")
        if failed.head(1):
            parents, children, terms, vectors = (_without(t, failed) for t in (parents, children, terms, vectors))
            dense = {model: _without(rows, failed) for model, rows in dense.items()}
            idf = materialize(index.term_idf(terms), "idf") if terms is not None else None
    dense = {model: rows.select("kb_id", "doc_id", "parent_id", "child_id", "embedding") for model, rows in dense.items()}
    if vectors is not None:
        vectors = vectors.select("kb_id", "chunk_id", "is_parent", "vectors")
    return Corpus(parents, children, terms, idf, dense, vectors, failed)


def _token_vectors(parents: DataFrame, children: DataFrame, embed) -> DataFrame:
    """Token vectors of parents and children alike: a rerank may look at either."""
    chunks = parents.select(
        "kb_id", "doc_id", F.col("parent_id").alias("chunk_id"), F.lit(True).alias("is_parent"), "content"
    ).unionByName(
        children.select(
            "kb_id", "doc_id", F.col("child_id").alias("chunk_id"), F.lit(False).alias("is_parent"), "content"
        )
    )
    made = embed(chunks)
    told = [ERROR] if ERROR in made.columns else []
    return made.select("kb_id", "doc_id", "chunk_id", "is_parent", F.col("embedding").alias("vectors"), *told)


def _parents(documents: DataFrame, config: KbConfig) -> DataFrame:
    if config.chunking_method == "fix-sized":
        return chunking.chunk_fixed(documents, config.max_chunk_size)
    return chunking.chunk_recursive(documents, config.max_chunk_size)


def _semantic_parents(documents: DataFrame, config: KbConfig, embed) -> tuple[DataFrame, DataFrame | None]:
    """Parents of the documents whose sentences could all be embedded, and the others' failures."""
    said = embed(chunking.semantic_sentences(documents))
    failures = None
    if ERROR in said.columns:
        said = materialize(said, "sentences")
        failures = materialize(_failures(said, config.chunking_model_id, ["pos"]), "failed")
        documents, said = _without(documents, failures), _without(said, failures).drop(ERROR)
    return chunking.semantic_parents(documents, said, config.min_chunk_size, config.max_chunk_size), failures


def with_source_pages(corpus: Corpus, pages: DataFrame) -> DataFrame:
    """Parents with the pages they touch."""
    touched = chunking.chunk_pages(corpus.parents, chunking.page_spans(pages))
    return corpus.parents.join(touched.select("parent_id", "pages"), "parent_id", "left").withColumn(
        "pages", F.coalesce("pages", F.array().cast("array<int>"))
    )
