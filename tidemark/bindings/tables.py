"""The given tables, and the inputs of our operators derived from them."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BM25, KbConfig
from tidemark.functions.text import tokenize
from tidemark.functions.vectors import hashed_terms
from tidemark.operators import chunking
from tidemark.plans.corpus import Corpus, build_corpus
from tidemark.plans.skew import materialize, spread

BASE = "main"
HASHED = "hashed"
FIXED_CONFIG = KbConfig(chunking_method="fix-sized", indexes=("bm25", HASHED), hyde_model_id="given")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str, by_language: bool = False) -> DataFrame:
    kb = F.col("lang") if by_language else F.lit(BASE)
    return spread(load(spark, sf_dir, "documents"), "doc_id").select(
        kb.alias("kb_id"), "doc_id", F.col("doc_id").cast("string").alias("source"), "text"
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document taken as one page."""
    return (
        load(spark, sf_dir, "documents")
        .select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("page_index", "markdown"))
        .select(
            F.col("lang").alias("kb_id"), "doc_id", F.col("doc_id").cast("string").alias("source"),
            "page_index", "markdown",
        )
    )


def html_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(
        F.lit("web").alias("kb_id"), F.col("page_id").alias("doc_id"), F.col("url").alias("source"),
        F.concat(F.lit("w"), "page_id").alias("parent_id"), F.lit(0).alias("seq"),
        F.lit(0).alias("start"), F.col("html").alias("content"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit(BASE).alias("kb_id"), "text"
    )


def embed_hashed(df: DataFrame) -> DataFrame:
    text = next(c for c in ("context", "content", "text") if c in df.columns)
    return df.withColumn("embedding", hashed_terms(tokenize(F.col(text))))


SPARSE = (BM25,)
_built: dict[tuple[str, str, tuple[str, ...]], Corpus] = {}
_chunked: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def corpus(spark: SparkSession, sf_dir: str, indexes: tuple[str, ...] = FIXED_CONFIG.indexes) -> Corpus:
    """All documents with these indexes, built once per application like any stored index."""
    place = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    for (*held, names), built in _built.items():
        if tuple(held) == place and set(indexes) <= set(names):
            return built
    built = build_corpus(documents(spark, sf_dir), replace(FIXED_CONFIG, indexes=indexes), {HASHED: embed_hashed})
    return _built.setdefault((*place, indexes), built)


def chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children of all documents, for what needs no index; those of an index if there is one."""
    place = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    for (*held, _), built in _built.items():
        if tuple(held) == place:
            return built.parents, built.children
    if place not in _chunked:
        parents = materialize(chunking.chunk_fixed(documents(spark, sf_dir)), "parents")
        _chunked[place] = parents, materialize(chunking.chunk_children(parents), "children")
    return _chunked[place]
