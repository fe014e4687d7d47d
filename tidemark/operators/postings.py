"""Sparse search that reads only the postings a query needs.

`cluster` turns index rows into blocks of postings, a task's rows at a time: up to `SEGMENT` children
make a segment, in which a child is a number and a posting that number and a count. A block holds up to
`BLOCK` children of one term and segment whose weights lie in one of `LEVELS` bands, and the best weight
among them. A segment's children are listed once, in a row without a term. So nothing is shuffled to
make blocks, and ids are stored per child, not per child and term. `save` stores blocks in order of
(base, term), in folders by a hash of the term, so a search opens the folders of its terms, and within
their files the parts that may hold them.

`search` gives the rows of search.sparse_search. Asked blocks come together by segment, and a segment
gives up its own best children per query, so pairs of queries and children never leave a task. Within a
segment, not all children that share a term are looked at:

1. A term can add at most its query weight times its best weight. The strongest terms of a query, half
   of what all can add, are read first; sums over a part of the terms are never above the whole, so the
   k-th best of them is a score that a result must reach.
2. Of the other terms, a block is read whole only if its best weight together with all weaker terms can
   reach that score: below that, a child found there alone is out.
3. Blocks left out of 2 are read for children that are still in, those whose sum so far and what the
   other terms can add reach the score.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.text import tokenize
from tidemark.operators.index import K1, term_weight
from tidemark.operators.search import PLACES, SHIPPED_QUERIES, _best, _found_schema, _ranked, query_terms
from tidemark.plans.skew import materialize

SEGMENT = 32_768  # children
BLOCK = 512
LEVELS = 8
FOLDERS = 256
NAMED_TERMS = 2000  # asked terms that are named to the scan
PUSHED = 10  # values of a list that Parquet looks up one by one
SLACK = 1e-6  # far above what the order of additions can change
LISTED = -1  # the folder of lists of children


def _folder(term: Column) -> Column:
    return F.when(term.isNull(), F.lit(LISTED)).otherwise(F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int"))


def cluster(indexed: DataFrame) -> DataFrame:
    """index.child_terms as blocks: folder, segment, kb_id, term, best, held array<struct<child, tf>>.

    A row without a term lists a segment's children in order of (parent_id, child_id), as
    children array<struct<parent_id, child_id, doc_len>>; `child` is the place in that list.
    """
    kinds = {c: indexed.schema[c].dataType for c in ("parent_id", "child_id")}
    listed = T.StructType().add("parent_id", kinds["parent_id"]).add("child_id", kinds["child_id"]).add("doc_len", T.LongType())
    held = T.ArrayType(T.StructType().add("child", T.IntegerType()).add("tf", T.IntegerType()))
    schema = T.StructType.fromDDL("segment string, kb_id string, term string, best double").add("held", held).add("children", T.ArrayType(listed))
    arrow = to_arrow_schema(schema)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, SEGMENT - n)
                batch, n = batch.slice(part.num_rows), n + part.num_rows
                waiting.append(part)
                if n == SEGMENT:
                    yield from _blocks(pa.Table.from_batches(waiting), arrow)
                    waiting, n = [], 0
        if waiting:
            yield from _blocks(pa.Table.from_batches(waiting), arrow)

    rows = indexed.select("kb_id", "parent_id", "child_id", F.col("doc_len").cast("long"), "terms", "tfs")
    return rows.mapInArrow(segments, schema).withColumn("folder", _folder(F.col("term")))


def _blocks(rows: pa.Table, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One segment: the row that lists its children, then its blocks."""
    rows = rows.sort_by([("parent_id", "ascending"), ("child_id", "ascending")]).combine_chunks()
    lists = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in ("parent_id", "child_id", "doc_len")], names=["parent_id", "child_id", "doc_len"])
    # named after its children, so that a task that runs again gives the same name to the same segment alone
    segment = blake2b(repr((rows["kb_id"].to_pylist(), rows["child_id"].to_pylist())).encode(), digest_size=16).hexdigest()
    none = {f.name: pa.nulls(1, f.type) for f in arrow}
    kind = arrow.field("children").type
    listed = {**none, "segment": pa.array([segment]), "children": pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists).cast(kind)}
    yield pa.RecordBatch.from_arrays([listed[f.name] for f in arrow], schema=arrow)

    terms, tfs = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks()
    size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
    if not size.sum():
        return
    words, bases = terms.flatten().dictionary_encode(), rows["kb_id"].combine_chunks().dictionary_encode()
    child = np.repeat(np.arange(len(size), dtype=np.int32), size)
    tf = tfs.flatten().to_numpy()
    weight = term_weight(tf.astype("float64"), rows["doc_len"].to_numpy()[child])
    level = np.floor(weight / (K1 + 1) * LEVELS).astype(np.int64)  # weights stay below K1 + 1
    base = bases.indices.to_numpy()[child].astype(np.int64)
    band = (base * len(words.dictionary) + words.indices.to_numpy()) * LEVELS + level
    order = np.argsort(band, kind="stable")
    band = band[order]
    new = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
    place = np.arange(len(band)) - np.repeat(new, np.diff(np.r_[new, len(band)]))
    first = np.flatnonzero(place % BLOCK == 0)
    child, tf, weight = child[order], tf[order], weight[order]
    key = band[first] // LEVELS
    n = len(first)
    held = pa.StructArray.from_arrays([pa.array(child), pa.array(tf, pa.int32())], names=["child", "tf"])
    columns = {
        "segment": pa.array([segment]).take(pa.array(np.zeros(n, dtype=np.int64))),
        "kb_id": bases.dictionary.take(pa.array(key // len(words.dictionary))),
        "term": words.dictionary.take(pa.array(key % len(words.dictionary))),
        "best": pa.array(np.maximum.reduceat(weight, first)),
        "held": pa.ListArray.from_arrays(pa.array(np.r_[first, len(band)], pa.int32()), held).cast(arrow.field("held").type),
        "children": pa.nulls(n, kind),
    }
    made = pa.RecordBatch.from_arrays([columns[f.name] for f in arrow], schema=arrow)
    for at in range(0, n, SEGMENT):
        yield made.slice(at, SEGMENT)


def save(blocks: DataFrame, path: str) -> None:
    """A folder is written by few tasks, but by more than one if it is large."""
    stored = blocks.hint("rebalance", "folder").sortWithinPartitions("folder", "kb_id", "term", F.desc("best"))
    stored.write.mode("overwrite").partitionBy("folder").parquet(os.path.join(path, "postings"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, "postings"))


def named(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Blocks of the asked (kb_id, term) alone; terms few enough are named to the scan, which then skips the rest."""
    asked = terms.select("kb_id", "term").distinct()
    few = [r["term"] for r in terms.select("term").distinct().limit(NAMED_TERMS + 1).collect()]  # bounded
    if len(few) <= NAMED_TERMS:
        folders = terms.sparkSession.createDataFrame([(t,) for t in few], "term string").select(_folder(F.col("term"))).distinct().collect()
        lists = [F.col("term").isin(few[i : i + PUSHED]) for i in range(0, len(few), PUSHED)]
        some = F.lit(False)
        while len(lists) > 1:  # a balanced tree of ORs, not a chain
            lists = [a | b for a, b in zip(lists[::2], [*lists[1::2], *([F.lit(False)] if len(lists) % 2 else [])])]
        some = lists[0] if lists else some
        blocks = blocks.where(F.col("folder").isin([f[0] for f in folders]) & some)
    return blocks.join(asked, ["kb_id", "term"], "left_semi")


def search(
    queries: DataFrame, blocks: DataFrame, idf: DataFrame, limit: int, per_parent: bool = False, tokens: Callable[[Column], Column] = tokenize
) -> DataFrame:
    """The `limit` best children (or parents, by their best child) that share a term.

    Queries are dealt into parts of about SHIPPED_QUERIES; a group is one segment and one part.
    """
    asked = materialize(query_terms(queries, idf, tokens), "query_terms")
    parts = max(1, -(-asked.agg(F.count_distinct("query_id")).head()[0] // SHIPPED_QUERIES))
    listed = blocks.where(F.col("folder") == LISTED)
    used = ["segment", "kb_id", "term", "best", "held", "children"]
    stored = listed.select(*used).unionByName(named(blocks, asked).select(*used))
    stored = stored.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    asked = asked.crossJoin(F.broadcast(listed.select(F.col("segment").alias("_of"))))
    ids = listed.select(F.inline("children"))
    schema = _found_schema(asked, ids)
    arrow = to_arrow_schema(schema)

    def best(terms: pa.Table, held: pa.Table) -> pa.Table:
        if held.num_rows and held["children"].null_count != held.num_rows - 1:
            raise ValueError("blocks must be stored, or made of rows that are dealt to tasks in the same way each time")
        if not terms.num_rows or held.num_rows < 2:
            return arrow.empty_table()
        return _segment(terms, held, limit, per_parent, arrow)

    found = asked.groupBy("_of", "_part").cogroup(stored.groupBy("segment", "_part")).applyInArrow(best, schema)
    return _ranked(found, limit, per_parent)


def _segment(asked: pa.Table, held: pa.Table, limit: int, per_parent: bool, arrow: pa.Schema) -> pa.Table:
    """The children of one segment that may be among a query's best, with their scores."""
    children = held.filter(pc.is_valid(held["children"]))["children"].combine_chunks().flatten()
    length = children.field("doc_len").to_numpy()
    parent = children.field("parent_id").dictionary_encode().indices.to_numpy()
    group = parent if per_parent else np.arange(len(children))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])

    held = held.filter(pc.is_valid(held["term"])).sort_by([("kb_id", "ascending"), ("term", "ascending"), ("best", "descending")]).combine_chunks()
    rows = held["held"].combine_chunks()
    ends = np.cumsum(pc.list_value_length(rows).to_numpy())
    flat = rows.flatten()
    child = flat.field("child").to_numpy()
    weight = term_weight(flat.field("tf").to_numpy().astype("float64"), length[child])
    bests, blocks_of = held["best"].to_numpy(), {}
    for i, key in enumerate(zip(held["kb_id"].to_pylist(), held["term"].to_pylist())):
        blocks_of.setdefault(key, [i, i])[1] = i + 1

    questions: dict = {}
    for query, *key, scale in zip(*(asked[c].to_pylist() for c in ("query_id", "kb_id", "term", "query_weight"))):
        if tuple(key) in blocks_of:
            questions.setdefault((query, key[0]), []).append((scale, *blocks_of[tuple(key)]))
    places, scores, who = [], [], []
    for asker, terms in questions.items():
        sums = _sums(terms, child, weight, ends, bests, starts, len(children), limit)
        sums[sums <= 0] = -np.inf
        at, _ = _best(sums[:, None], group, limit)
        places.append(at)
        scores.append(sums[at])
        who += [asker] * len(at)
    if not who:
        return arrow.empty_table()
    near = children.take(pa.array(np.concatenate(places)))
    columns = {
        "query_id": pa.array([q for q, _ in who]), "kb_id": pa.array([b for _, b in who]), "score": pa.array(np.concatenate(scores)),
        "parent_id": near.field("parent_id"), "child_id": near.field("child_id"),
    }
    return pa.table([columns[f.name] for f in arrow], names=arrow.names).cast(arrow)


def _sums(terms, child, weight, ends, bests, starts, n: int, limit: int) -> np.ndarray:
    """One query's scores of a segment's `n` children, -inf for those that cannot be among its `limit` best.

    `terms` holds (query weight, first block, block after the last) of each; a term's blocks go from the
    best down. `starts` are the first children of what counts once.
    """
    sums = np.zeros(n)

    def add(scale: float, first: int, last: int, among: np.ndarray | None = None) -> None:
        if first < last:
            cut = slice(ends[first - 1] if first else 0, ends[last - 1])
            held, parts = child[cut], scale * weight[cut]
            if among is not None:
                found = among[held]
                held, parts = held[found], parts[found]
            sums[held] += parts  # a term lists a child once

    terms = sorted(terms, key=lambda t: t[0] * bests[t[1]])
    most = np.array([scale * bests[first] for scale, first, _ in terms])
    through = np.cumsum(most)
    strong = int(np.flatnonzero(through > through[-1] / 2)[0])
    for scale, first, last in terms[strong:]:
        add(scale, first, last)
    reach = 0.0
    if len(starts) >= limit:
        reach = max(0.0, np.partition(np.maximum.reduceat(sums, starts), len(starts) - limit)[len(starts) - limit] - SLACK)
    closed, rest = [], through[strong - 1] if strong else 0.0
    for i in range(strong - 1, -1, -1):
        scale, first, last = terms[i]
        open_until = first + int(np.searchsorted(-(scale * bests[first:last] + through[i] - most[i]), -reach, side="right"))
        add(scale, first, open_until)
        closed.append((scale, open_until, last))
    still = (sums > 0) & (sums + rest >= reach)
    for scale, first, last in closed:
        add(scale, first, last, still)
    return np.where(still, np.round(sums, PLACES), -np.inf)
