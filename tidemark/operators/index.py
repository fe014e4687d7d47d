"""Index tables: BM25 postings, term statistics, dense and per-token vectors.

Weights use a fixed average length, so postings need no pass over the corpus and no shuffle;
only the term statistics are aggregated.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import tokenize

# BM25 constants; index and query must use the same.
K1 = 1.2
B = 0.75
AVERAGE_LENGTH = 256
WEIGHTED = T.ArrayType(T.StructType().add("term", T.StringType()).add("tf", T.IntegerType()).add("weight", T.DoubleType()))


def term_weight(tf: Column, length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / AVERAGE_LENGTH))


@F.arrow_udf(WEIGHTED)
def weighted_terms(terms: pa.Array) -> pa.Array:
    """An array of terms to array<struct<term, tf, weight>>, in order of first use; rows are counted a batch at once."""
    length = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
    words = terms.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(length)), length)
    pairs = owner * max(1, len(words.dictionary)) + words.indices.to_numpy()
    _, first, tf = np.unique(pairs, return_index=True, return_counts=True)
    order = np.argsort(first)
    first, tf = first[order], tf[order]
    weight = term_weight(tf.astype("float64"), length[owner[first]])
    held = [words.dictionary.take(words.indices.take(pa.array(first))), pa.array(tf, pa.int32()), pa.array(weight)]
    ends = np.r_[0, np.cumsum(np.bincount(owner[first], minlength=len(length)))]
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.StructArray.from_arrays(held, names=["term", "tf", "weight"]), mask=terms.is_null()
    )


def child_terms(children: DataFrame, tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """The stored index: one row per child with its terms, counts and weights side by side."""
    weighted = children.withColumn("_weighted", weighted_terms(tokens(F.col("content"))))
    return weighted.select(
        "kb_id", "doc_id", "parent_id", "child_id",
        F.aggregate("_weighted", F.lit(0), lambda n, w: n + w["tf"]).alias("doc_len"),
        F.col("_weighted.term").alias("terms"),
        F.col("_weighted.tf").alias("tfs"),
        F.col("_weighted.weight").alias("weights"),
    )


def postings(indexed: DataFrame) -> DataFrame:
    """child_terms as one row per child and term. Nothing is shuffled."""
    rows = F.arrays_zip(
        F.col("terms").alias("term"), F.col("tfs").alias("tf"), F.col("weights").alias("weight")
    )
    return indexed.select("kb_id", "doc_id", "parent_id", "child_id", "doc_len", F.inline(rows))


def rarity(children: Column, holding: Column) -> Column:
    """Inverse document frequency of a term that `holding` of a base's `children` hold."""
    return F.log(1 + (children - holding + 0.5) / (holding + 0.5))


def term_idf(indexed: DataFrame) -> DataFrame:
    """Per base and term: children holding it and its inverse document frequency.

    `indexed` is child_terms. A child lists a term once, so a plain count is the document
    frequency, and each task adds up its own rows before the shuffle.
    """
    sizes = indexed.groupBy("kb_id").agg(F.count("*").alias("n_children"))
    held = (
        indexed.select("kb_id", F.explode("terms").alias("term"))
        .groupBy("kb_id", "term")
        .agg(F.count("*").alias("df"))
    )
    found = held.join(sizes, "kb_id")
    return found.select("kb_id", "term", "df", "n_children", rarity(F.col("n_children"), F.col("df")).alias("idf"))


def multivec_rows(token_vectors: DataFrame) -> DataFrame:
    """(kb_id, chunk_id, is_parent, vectors array<array<float>>) to one row per token."""
    return token_vectors.select(
        "kb_id", "chunk_id", "is_parent", F.posexplode("vectors").alias("token_pos", "embedding")
    )


def index_points(children: DataFrame, pages: DataFrame) -> DataFrame:
    """Every child with what the index keeps beside its vectors: parent, source, pages."""
    return children.join(pages.select("parent_id", "pages"), "parent_id", "left").select(
        "kb_id",
        "parent_id",
        "child_id",
        F.col("doc_id").alias("node_id"),
        "content",
        "source",
        F.coalesce("pages", F.array().cast("array<int>")).alias("pages"),
        F.lit(False).alias("is_parent"),
    )


def delete_nodes(points: DataFrame, deleted: DataFrame) -> DataFrame:
    """Index rows that remain once the nodes in `deleted(node_id)` are gone."""
    return points.join(deleted.select("node_id").distinct(), "node_id", "left_anti")


def layout_changed(configs: DataFrame) -> DataFrame:
    """Bases whose set of index names differs, so their index must be rebuilt.

    `configs` has kb_id, before and after (arrays of index names) and reranker_before,
    reranker_after. Order and repeats do not count, and neither does the reranker. So a base
    that gains late interaction has no token vectors until its files are indexed again, and
    scores 0.0 there: `missing_token_vectors` marks it.
    """

    def names(column: str) -> Column:
        return F.array_sort(F.array_distinct(column))

    late = F.lit("late-interaction")
    gained = F.col("reranker_after").eqNullSafe(late) & ~F.col("reranker_before").eqNullSafe(late)
    changed = names("before") != names("after")
    return configs.withColumn("changed", changed).withColumn(
        "missing_token_vectors", ~changed & gained
    )
