"""Search a batch of queries against index tables.

Queries are queries(query_id, kb_id, text). Scores are rounded to 9 places and ties go to the
smaller id, so a rank does not hang on the order in which Spark adds numbers up. Ranks of fused
legs differ by more than that down to rank 30,000.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.text import tokenize
from tidemark.operators.index import weighted_terms
from tidemark.plans.skew import materialize, small_enough, top_k

PLACES = 9
SHIPPED_QUERIES = 512  # sparse queries, with SHIPPED_TERMS terms, that are sent to the index
SHIPPED_TERMS = 40_000
TILE = 2000  # dense queries sent to the index; beyond, the least queries and rows of a tile
TILE_BYTES = 1 << 25  # of vectors in a tile at most
GROUPS_PER_CORE = 4  # pairs of tiles
BLOCK = 8192  # rows scored at once
BLOCK_CELLS = 1 << 20  # scores at once
SEGMENT = 64  # rows whose best score is looked at first
SCORE_CELLS = 4_000_000

BEST_FIRST = ("-score", "child_id")


# --- sparse ---------------------------------------------------------------------------------


def query_terms(
    queries: DataFrame, idf: DataFrame, tokens: Callable[[Column], Column] = tokenize
) -> DataFrame:
    """Query terms weighted like a document's, times the base's idf. Unknown terms drop out."""
    encoded = queries.withColumn("_weighted", weighted_terms(tokens(F.col("text")))).select(
        "query_id", "kb_id", F.inline("_weighted")
    )
    found = idf.select("kb_id", "term", "idf").join(encoded, ["kb_id", "term"])
    return found.select("query_id", "kb_id", "term", (F.col("weight") * F.col("idf")).alias("query_weight"))


def sparse_search(
    queries: DataFrame,
    indexed: DataFrame,
    idf: DataFrame,
    limit: int,
    per_parent: bool = False,
    tokens: Callable[[Column], Column] = tokenize,
) -> DataFrame:
    """The `limit` best children (or parents, by their best child) that share a term.

    `indexed` is index.child_terms: each child's terms lie in one row. A small set of queries, by
    its counted size, is sent to the rows, and a task gives up only its own best, so the index is
    not shuffled. Larger sets stay on the executors: query terms meet the index's terms in a join,
    whose hot terms adaptive execution splits, and products are summed per (query, child).
    """
    terms = materialize(query_terms(queries, idf, tokens), "query_terms")
    asked = terms.agg(F.count_distinct("query_id"), F.count("*")).head()
    if asked[0] <= SHIPPED_QUERIES and asked[1] <= SHIPPED_TERMS:
        return _scan(terms, indexed, limit, per_parent, _sparse)
    held = indexed.join(terms.select("kb_id").distinct(), "kb_id", "left_semi").select(
        "kb_id", "parent_id", "child_id", F.explode(F.arrays_zip("terms", "weights")).alias("_held")
    )
    held = held.select("kb_id", "parent_id", "child_id", F.col("_held.terms").alias("term"), F.col("_held.weights").alias("_weight"))
    scored = held.join(terms, ["kb_id", "term"]).groupBy("query_id", "kb_id", "parent_id", "child_id").agg(
        F.round(F.sum(F.col("query_weight") * F.col("_weight")), PLACES).alias("score")
    ).where("score > 0")
    return _ranked(scored, limit, per_parent)


def _sparse(block: pd.DataFrame):
    """Score function of one block of query terms, per base."""
    bases = {}
    for base, part in block.groupby("kb_id"):
        ids, column = np.unique(part["query_id"].to_numpy(), return_inverse=True)
        words, row = np.unique(part["term"].to_numpy(dtype=object), return_inverse=True)
        weights = np.zeros((len(words), len(ids)))
        weights[row, column] = part["query_weight"]
        bases[base] = (ids, pa.array(words, pa.string()), weights)

    def score(base: str, rows: pa.Table):
        ids, words, query_weights = bases[base]
        terms, weights = rows["terms"].combine_chunks(), rows["weights"].combine_chunks()
        codes = pc.fill_null(pc.index_in(terms.flatten(), value_set=words), -1).to_numpy()
        lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        used = codes >= 0
        owner, codes, held = owner[used], codes[used], weights.flatten().to_numpy()[used]
        scores = np.zeros((len(lengths), len(ids)))
        step = max(1, SCORE_CELLS // max(1, len(ids)))
        for at in range(0, len(owner), step):
            cut = slice(at, at + step)
            firsts = np.flatnonzero(np.r_[True, np.diff(owner[cut]) > 0])
            sums = np.add.reduceat(query_weights[codes[cut]] * held[cut, None], firsts, axis=0)
            scores[owner[cut][firsts]] += sums
        return ids, np.where(scores > 0, np.round(scores, PLACES), -np.inf)

    return bases.keys(), score


# --- scanning an index with a block of queries ----------------------------------------------


def _ranked(found: DataFrame, limit: int, per_parent: bool) -> DataFrame:
    return top_k(best_children(found) if per_parent else found, ["query_id"], BEST_FIRST, limit)


def _found_schema(queries: DataFrame, rows: DataFrame) -> T.StructType:
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (rows, "parent_id"), (rows, "child_id"))]
    return T.StructType.fromDDL("query_id {}, kb_id string, parent_id {}, child_id {}, score double".format(*kinds))


def _scan(queries: DataFrame, rows: DataFrame, limit: int, per_parent: bool, make) -> DataFrame:
    """Send one block of queries, of checked size, to the index; every task gives its best rows per query."""
    schema = _found_schema(queries, rows)
    used = [c for c in ("terms", "weights", "embedding") if c in rows.columns]
    asked = F.broadcast(queries.select("kb_id").distinct())
    sent = rows.select("kb_id", "parent_id", "child_id", *used).join(asked, "kb_id", "left_semi")
    shipped = rows.sparkSession.sparkContext.broadcast(queries.toPandas())
    scan = _scanner([shipped], make, limit, "parent_id" if per_parent else "child_id", schema)
    return _ranked(sent.mapInArrow(scan, schema), limit, per_parent)


def _tiled(queries: DataFrame, rows: DataFrame, limit: int, per_parent: bool) -> DataFrame:
    """Queries and rows of a base are dealt into tiles; every pair of tiles is a group.

    A side has as many tiles as keep all cores busy, none below TILE vectors, and more only beyond
    TILE_BYTES of vectors in one. So a vector is sent a few times, whatever the size of a base that
    fits these tiles, a group holds two tiles and one block of scores, and nothing passes through
    the driver. A group gives up `limit` rows per query.
    """
    schema = _found_schema(queries, rows)
    spread = math.ceil((GROUPS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism) ** 0.5)

    def sized(df: DataFrame, name: str) -> DataFrame:
        large = F.ceil(F.count("*") * F.max(F.size("embedding")) * 4 / TILE_BYTES)
        return df.groupBy("kb_id").agg(F.greatest(large, F.least(F.ceil(F.count("*") / TILE), F.lit(spread))).cast("int").alias(name))

    tiles = sized(queries, "_q").join(sized(rows, "_r"), "kb_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    asked = queries.join(tiles, "kb_id").withColumn("_qt", mine("query_id", "_q")).withColumn("_rt", each("_r")).drop("_q", "_r")
    held = rows.select("kb_id", "parent_id", "child_id", "embedding").join(tiles, "kb_id")
    held = held.withColumn("_rt", mine("child_id", "_r")).withColumn("_qt", each("_q")).drop("_q", "_r")
    arrow, group = to_arrow_schema(schema), "parent_id" if per_parent else "child_id"

    def meet(block: pa.Table, part: pa.Table) -> pa.Table:
        if not block.num_rows or not part.num_rows:
            return arrow.empty_table()
        part = part.sort_by(group)
        best = Best(_matrix(block["embedding"]), part, group, limit)
        wanted, vectors = best.queries.astype(np.float32), best.vectors.astype(np.float32)
        for some in _blocks(best.group, BLOCK, best.distinct()):
            step, near = max(1, BLOCK_CELLS // len(some)), vectors[some].T
            for start in range(0, len(wanted), step):
                asking = np.arange(start, min(start + step, len(wanted)))
                best.look(asking, some, wanted[asking] @ near)
        return best.found(block, part).select(arrow.names).cast(arrow)

    keys = ["kb_id", "_qt", "_rt"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, schema)
    return _ranked(found, limit, per_parent)


def _near(score, base: str, rows: pa.Table, group: str, limit: int, arrow: pa.Schema) -> pa.Table:
    """The rows (sorted by `group`) that may be among a query's best, with their scores."""
    ids, scores = score(base, rows)
    at, to = _best(scores, rows[group].to_numpy(), limit)
    near = rows.select(["kb_id", "parent_id", "child_id"]).take(pa.array(at))
    near = near.append_column("query_id", pa.array(ids[to])).append_column("score", pa.array(scores[at, to]))
    return near.select(arrow.names).cast(arrow)


def _scanner(shipped, make, limit: int, group: str, schema: T.StructType):
    arrow = to_arrow_schema(schema)
    order = [("query_id", "ascending"), ("score", "descending"), ("child_id", "ascending")]

    def cut(tables: list[pa.Table]) -> pa.Table:
        best = pa.concat_tables(tables).sort_by(order).to_pandas()
        best = best.drop_duplicates(["query_id", group]).groupby("query_id", sort=False).head(limit)
        return pa.Table.from_pandas(best, schema=arrow, preserve_index=False)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [make(block.value) for block in shipped]
        most = 4 * limit * sum(block.value["query_id"].nunique() for block in shipped)
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for base in pc.unique(table["kb_id"]).to_pylist():
                asked = [score for bases, score in scorers if base in bases]
                if not asked:
                    continue
                rows = table.filter(pc.equal(table["kb_id"], base)).sort_by(group)
                step = max(1, SCORE_CELLS // max(1, most // (4 * limit)))
                for score in asked:
                    for start in range(0, rows.num_rows, step):
                        held.append(_near(score, base, rows.slice(start, step), group, limit, arrow))
            if sum(t.num_rows for t in held) > most:
                held = [cut(held)]
        if held:
            yield from cut(held).to_batches()

    return scan


# --- dense ----------------------------------------------------------------------------------


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _best(scores: np.ndarray, groups: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sorted by group) and columns that may be in a column's top `limit` groups."""
    firsts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[firsts, len(groups)])
    tops = np.maximum.reduceat(scores, firsts, axis=0)
    if len(firsts) > limit:
        floor = np.partition(tops, len(firsts) - limit, axis=0)[len(firsts) - limit]
        kept = tops >= floor
    else:
        kept = np.ones_like(tops, dtype=bool)
    kept &= tops > -np.inf
    return np.nonzero(np.repeat(kept, sizes, axis=0) & (scores == np.repeat(tops, sizes, axis=0)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, a row each."""
    held = column.combine_chunks()
    sizes = pc.list_value_length(held)
    if held.null_count or pc.count_distinct(sizes).as_py() > 1:
        raise ValueError("vectors of one model must have one length")
    return _unit(held.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(held), -1))


def _blocks(group: np.ndarray, size: int, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (sorted by group) in blocks of whole groups, of `size` or so."""
    firsts = np.flatnonzero(np.r_[True, np.diff(group[rows]) != 0])
    ends = np.unique(firsts[np.searchsorted(firsts, np.arange(size, len(rows), size), side="right") - 1])
    yield from np.split(rows, ends[ends > 0])


class Best:
    """The `limit` best groups per query among rows, from blocks of scores in single precision.

    `rows` are sorted by group. Of a block's scores only those count that may be, by the error of
    single precision, among a query's best of this block and of those before; they are worked out
    again in double precision. A block holds whole groups, so the k-th best of its groups is a bound.
    """

    def __init__(self, queries: np.ndarray, rows: pa.Table, group: str, limit: int, floor: np.ndarray | None = None):
        self.queries, self.vectors, self.limit = queries, _matrix(rows["embedding"]), limit
        self.slack = 2.0 ** -22 * (queries.shape[1] + 8) + 10.0**-PLACES
        order = lambda name: pc.rank(rows[name].combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        self.child = order("child_id")
        self.group = self.child if group == "child_id" else order(group)
        self.one = group != "child_id"  # row of a group counts
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor - self.slack
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def distinct(self) -> np.ndarray:
        """Rows that can be among a query's best, in order: of equal vectors the first `limit`."""
        plain = np.ascontiguousarray(self.vectors + 0.0)
        same = np.unique(plain.view(np.dtype((np.void, plain.itemsize * plain.shape[1]))).ravel(), return_inverse=True)[1]
        return np.sort(self._first(same, np.arange(len(same)), np.zeros(len(same)))[1])

    def look(self, asking: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """`scores` of the queries `asking` (down) and `rows`, each group side by side (across); -inf does not count."""
        group = self.group[rows]
        firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        cuts = np.unique(firsts[np.searchsorted(firsts, np.arange(0, len(rows), SEGMENT), side="right") - 1])
        tops = np.maximum.reduceat(scores, cuts, axis=1)
        floor = self.floor[asking]
        if len(cuts) >= self.limit:
            floor = self.floor[asking] = np.maximum(floor, np.partition(tops, -self.limit, axis=1)[:, -self.limit] - self.slack)
        to, segment = np.nonzero((tops >= floor[:, None]) & (tops > -np.inf))
        sizes = np.diff(np.r_[cuts, len(rows)])[segment]
        at = np.arange(sizes.sum()) + np.repeat(cuts[segment] - (np.cumsum(sizes) - sizes), sizes)
        to = np.repeat(to, sizes)
        held = scores[to, at]
        near = (held >= floor[to]) & (held > -np.inf)
        to, at = asking[to[near]], rows[at[near]]
        exact = np.empty(len(to))
        step = max(1, SCORE_CELLS // self.vectors.shape[1])
        for i in range(0, len(to), step):
            exact[i : i + step] = np.einsum("ij,ij->i", self.vectors[at[i : i + step]], self.queries[to[i : i + step]])
        self.parts.append(self._first(to, at, np.round(exact, PLACES) + 0.0))
        self.held += len(self.parts[-1][0])
        if self.held > 4 * self.limit * (len(self.queries) + 100_000):
            self._merge()

    def _first(self, to: np.ndarray, at: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        """The `limit` best of each `to`, the smaller child on a tie."""
        order = np.lexsort((self.child[at], -score, to))
        to, at, score = to[order], at[order], score[order]
        if len(to):
            key = to * (self.group.max() + 1) + self.group[at]
            _, first, its = np.unique(key, return_index=True, return_inverse=True)
            kept = np.sort(first) if self.one else np.flatnonzero(score == score[first[its]])
            to, at, score = to[kept], at[kept], score[kept]
            firsts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            place = np.arange(len(to)) - np.repeat(firsts, np.diff(np.r_[firsts, len(to)]))
            to, at, score = (x[place < self.limit] for x in (to, at, score))
        return to, at, score

    def _merge(self) -> None:
        self.parts = [self._first(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))] if self.parts else []
        self.held = sum(len(x[0]) for x in self.parts)

    def found(self, asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The best rows with their query's id and score."""
        self._merge()
        to, at, score = self.parts[0] if self.parts else (np.zeros(0, int),) * 3
        found = rows.select(["kb_id", "parent_id", "child_id"]).take(pa.array(at))
        return found.append_column("query_id", asked["query_id"].take(pa.array(to))).append_column("score", pa.array(score, pa.float64()))


def dense_search(
    queries: DataFrame,
    dense: DataFrame,
    limit: int,
    per_parent: bool = False,
) -> DataFrame:
    """Nearest children by cosine: queries(query_id, kb_id, embedding) against
    dense(kb_id, parent_id, child_id, embedding), within one base.

    Up to TILE queries, counted first, are sent to the vectors, which are read once and not
    shuffled. More queries and the vectors meet in tiles of bounded size. Either way a matrix
    product gives up all but its own best rows, so no (query, child) pairs are built. With
    `per_parent` a parent counts once, by its best child. For an index see `nearest`.
    """
    vectors = materialize(queries.select("query_id", "kb_id", F.col("embedding").cast("array<float>")), "query_vectors")
    if vectors.count() <= TILE:
        return _scan(vectors, dense, limit, per_parent, _dense)
    return _tiled(vectors, dense, limit, per_parent)


def _dense(block: pd.DataFrame):
    """Score function of one block of query vectors, per base."""
    bases = {
        base: (part["query_id"].to_numpy(), _unit(np.vstack(part["embedding"]).astype("float64")))
        for base, part in block.groupby("kb_id")
    }

    def score(base: str, rows: pa.Table):
        ids, wanted = bases[base]
        flat = rows["embedding"].combine_chunks().flatten().to_numpy().astype("float64")
        vectors = _unit(flat.reshape(rows.num_rows, -1))
        scores = np.round(vectors @ wanted.T, PLACES) + 0.0
        return ids, scores

    return bases.keys(), score


# --- fusion and parents ---------------------------------------------------------------------


def fuse(legs: Sequence[DataFrame], prefetch: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked legs, each cut to `prefetch` children before it."""
    ranked = None
    for leg in legs:
        part = leg.where(F.col("rank") <= prefetch).select(
            "query_id", "kb_id", "parent_id", "child_id", "rank"
        )
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy("query_id", "kb_id", "parent_id", "child_id").agg(
        F.round(F.sum(1 / (F.lit(float(rrf_k)) + F.col("rank"))), PLACES).alias("score")
    )
    return fused


def best_children(scored: DataFrame) -> DataFrame:
    """One row per query and parent: the best child, the smaller id on a tie."""
    best = F.min(F.struct((-F.col("score")).alias("_minus"), F.col("child_id")))
    return (
        scored.groupBy("query_id", "kb_id", "parent_id")
        .agg(best.alias("_best"))
        .select(
            "query_id", "kb_id", "parent_id",
            F.col("_best.child_id").alias("child_id"),
            (-F.col("_best._minus") + 0.0).alias("score"),
        )
    )


def collapse_parents(scored: DataFrame, pool: int) -> DataFrame:
    """The `pool` best parents per query, each by its best child."""
    return top_k(best_children(scored), ["query_id"], BEST_FIRST, pool)


def search_text(queries: DataFrame, hypotheses: DataFrame | None) -> DataFrame:
    """Queries with the text to search by: the hypothetical passage where there is one.

    `text` is replaced and the original stays in `asked`, which reranking uses.
    """
    asked = queries.withColumn("asked", F.col("text"))
    if hypotheses is None:
        return asked
    written = hypotheses.select("query_id", F.col("text").alias("_passage"))
    return (
        asked.join(written, "query_id", "left")
        .withColumn("text", F.coalesce("_passage", "text"))
        .drop("_passage")
    )


def hydrate(hits: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """Add parent text, source and the matched child's text. A hit whose parent is gone stays.

    Hits are few (queries x pool), so they are made the broadcast side of two scans; when they
    are too many for that, both joins become ordinary shuffled joins on unique ids.
    """
    hits = materialize(hits, "hits")
    keys = ["kb_id", "parent_id", "child_id"]
    wanted = hits.select(*keys).distinct()
    text = parents.select("kb_id", "parent_id", "content", F.col("source"))
    matched = children.select("kb_id", "child_id", F.col("content").alias("matched_text"))
    if small_enough(wanted):
        text = text.join(F.broadcast(wanted.select("kb_id", "parent_id").distinct()), ["kb_id", "parent_id"], "left_semi")
        matched = matched.join(F.broadcast(wanted.select("kb_id", "child_id").distinct()), ["kb_id", "child_id"], "left_semi")
    return hits.join(text, ["kb_id", "parent_id"], "left").join(matched, ["kb_id", "child_id"], "left")


# --- reranking ------------------------------------------------------------------------------


def overlap_score(query: Column, text: Column) -> Column:
    """A built-in lexical scorer: share of the query's distinct terms found in the text."""
    asked = F.array_distinct(tokenize(query))
    found = F.size(F.array_intersect(asked, tokenize(text)))
    share = found / F.greatest(F.size(asked), F.lit(1))
    return F.round(share, PLACES)


def rerank(
    hits: DataFrame, queries: DataFrame, on: str, score: Callable[[Column, Column], Column] = overlap_score
) -> DataFrame:
    """Score hydrated hits again by (query, text). Equal scores keep the order they had."""
    text = F.coalesce(F.col("content" if on == "parent" else "matched_text"), F.lit(""))
    asked = queries.select(
        "query_id", F.col("asked" if "asked" in queries.columns else "text").alias("_asked")
    )
    scored = (
        hits.join(asked, "query_id")
        .withColumn("prior_rank", F.col("rank"))
        .withColumn("score", F.coalesce(score(F.col("_asked"), text), F.lit(0.0)))
        .drop("rank", "_asked")
    )
    return reorder(scored)


def reorder(scored: DataFrame) -> DataFrame:
    """Rank by score; `prior_rank` decides ties. A query has at most its pool of rows."""
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("prior_rank"))
    return scored.withColumn("rank", F.row_number().over(window))


def maxsim(query_vectors: Column, chunk_vectors: Column) -> Column:
    """For every query token its best cosine over the chunk's tokens, summed up; null without tokens.

    Tokens of a batch lie one after another. Pairs of texts with numbers of tokens alike, to the
    next power of two, are multiplied as one stack of matrices.
    """

    @F.arrow_udf("double")
    def score(asked: pa.Array, held: pa.Array) -> pa.Array:
        (q, q_first, q_size), (c, c_first, c_size) = _tokens(asked), _tokens(held)
        out = np.full(len(asked), np.nan)
        both = np.flatnonzero((q_size > 0) & (c_size > 0))
        shapes = 1 << np.ceil(np.log2(np.stack([q_size[both], c_size[both]], axis=1))).astype(int)
        for n, m in np.unique(shapes, axis=0).tolist():
            alike = both[(shapes == (n, m)).all(axis=1)]
            step = max(1, SCORE_CELLS // (n * m + (n + m) * q.shape[1]))
            for i in range(0, len(alike), step):
                rows = alike[i : i + step]
                left, right = _stacked(q, q_first[rows], q_size[rows], n), _stacked(c, c_first[rows], c_size[rows], m)
                cosines = left @ right.transpose(0, 2, 1)
                cosines[np.broadcast_to((np.arange(m) >= c_size[rows, None])[:, None, :], cosines.shape)] = -np.inf
                best = np.where(np.arange(n) < q_size[rows, None], cosines.max(axis=2), 0.0)
                out[rows] = np.round(best.sum(axis=1), PLACES)
        return pa.array(out, mask=np.isnan(out))

    return score(query_vectors, chunk_vectors)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of all tokens of array<array<float>>, and each text's first and number of tokens."""
    size = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
    vectors = texts.flatten()
    flat = vectors.flatten().to_numpy().astype("float64")
    matrix = _unit(flat.reshape(len(vectors), -1)) if len(vectors) else np.zeros((0, 1))
    return matrix, np.cumsum(size) - size, size


def _stacked(vectors: np.ndarray, first: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Texts of `size` tokens from `first` on as one array, n tokens each; what is beyond repeats the last."""
    return vectors[first[:, None] + np.minimum(np.arange(n), size[:, None] - 1)]


def maxsim_rerank(hits: DataFrame, query_tokens: DataFrame, chunk_tokens: DataFrame, on: str) -> DataFrame:
    """Late-interaction rerank. Chunks without stored vectors score 0.0 and keep their order.

    query_tokens(query_id, vectors) and chunk_tokens(kb_id, chunk_id, vectors) hold one row
    per text with all its token vectors. Only the candidates' rows are read on.
    """
    key = "parent_id" if on == "parent" else "child_id"
    hits = materialize(hits, "hits")
    wanted = hits.select("kb_id", F.col(key).alias("chunk_id")).distinct()
    chunks = chunk_tokens.select("kb_id", "chunk_id", F.col("vectors").alias("_held"))
    held = (
        chunks.join(F.broadcast(wanted), ["kb_id", "chunk_id"], "left_semi")
        if small_enough(wanted)
        else chunks.join(wanted, ["kb_id", "chunk_id"], "left_semi")
    )
    asked = query_tokens.select("query_id", F.col("vectors").alias("_asked"))
    scored = (
        hits.withColumn("chunk_id", F.col(key))
        .join(held, ["kb_id", "chunk_id"], "left")
        .join(asked, "query_id", "left")
        .withColumn("prior_rank", F.col("rank"))
        .withColumn("score", F.coalesce(maxsim(F.col("_asked"), F.col("_held")), F.lit(0.0)))
        .drop("rank", "_asked", "_held", "chunk_id")
    )
    return reorder(scored)


# --- around a search ------------------------------------------------------------------------


def empty_queries(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries that found nothing."""
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")


def unanswerable(queries: DataFrame, idf: DataFrame, tokens: Callable[[Column], Column] = tokenize) -> DataFrame:
    """Queries that sparse_search can find nothing for: their base holds none of their terms.

    Terms meet the base's statistics, a row per term, so no pairs of queries and children are made.
    """
    asked = queries.select("query_id", "kb_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    known = asked.join(idf.select("kb_id", "term"), ["kb_id", "term"], "left_semi")
    return empty_queries(queries, known)


def unavailable_indexes(requested: DataFrame, available: DataFrame) -> DataFrame:
    """(kb_id, index_name) asked for and not there."""
    keys = ["kb_id", "index_name"]
    return requested.select(*keys).distinct().join(available.select(*keys), keys, "left_anti")


def context_passages(hits: DataFrame) -> DataFrame:
    """Per query the top hits' texts joined by blank lines, best first."""
    passage = F.struct("rank", F.coalesce("content", "matched_text").alias("passage"))
    ordered = F.array_sort(F.collect_list(passage))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["passage"]), "\n\n").alias("passages")
    )
