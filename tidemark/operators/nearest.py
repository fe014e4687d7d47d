"""Nearest neighbours from inverted lists of vectors: approximate with bit sketches, or exact with bounds.

`build` works out per base centroids of a bounded sample, puts every vector into the list of its
nearest centroid and stores it there beside a sketch: the sides of `BITS` random planes it lies on.
Lists are stored in order, so that a search reads only the parts of files that hold its lists.

`search` sends a query to the lists of its nearest centroids. How many that must be depends on the
data: `build` measures it on the sample, as the number of lists that hold `COVERAGE` of the sample's
true neighbours. Within a list a query's sketch is compared with all others by counting differing
bits, and only the nearest few (more in the first lists) are multiplied out, so results carry exact
cosines. Lists beyond
`TILE` rows, and many queries to one list, are split into tiles that meet as groups of their own.

`exact` finds all nearest neighbours. The k-th score of the nearest few lists, looked into wholly, must
be reached; a list is looked into only if that is possible for a vector as far from the list's centroid
as its farthest member, in the direction of the query (angles obey the triangle inequality).

The sample is the `SAMPLE` rows of smallest id hash of each base; every vector is indexed. Vectors
that are null or empty are not indexed and find nothing.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.search import BLOCK_CELLS, GROUPS_PER_CORE, Best, _found_schema, _matrix, _ranked, _unit
from tidemark.plans.skew import materialize, top_k

SAMPLE = 16_384
MOST_LISTS = 1024
TURNS = 10
COVERAGE = 0.99
NEIGHBOURS = 10
BITS = 512
TILE = 20_000  # rows, or queries, of a tile; less, to LEAST_TILE, keeps all cores busy, more, to TILE_BYTES, sends less
LEAST_TILE = 4096
TILE_BYTES = 1 << 24  # of vectors in a tile
LISTS_BLOCK = 2048  # rows of lists scored at once
LEAST_KEPT = 2
SHARE_KEPT = 0.05
FIRST_LISTS = 8  # looked into wholly for a bound, or as many as hold FIRST_ROWS rows per result
FIRST_ROWS = 20
SEED = 17
SLACK = 1e-6

Kernel = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Lists:
    """centroids(kb_id, list, centroid, probes, radius, rows), vectors(kb_id, list, parent_id, child_id, embedding, sketch).

    radius is the largest angle of a member to the centroid.
    """

    centroids: DataFrame
    vectors: DataFrame

    def save(self, path: str) -> None:
        """Stored with its lists in order; `open_lists` reads it in any session."""
        self.centroids.write.mode("overwrite").parquet(os.path.join(path, "centroids"))
        _in_order(self.vectors).write.mode("overwrite").parquet(os.path.join(path, "vectors"))


def open_lists(spark: SparkSession, path: str) -> Lists:
    return Lists(spark.read.parquet(os.path.join(path, "centroids")), spark.read.parquet(os.path.join(path, "vectors")))


def _in_order(vectors: DataFrame) -> DataFrame:
    return vectors.repartitionByRange("kb_id", "list", "child_id").sortWithinPartitions("kb_id", "list", "child_id")


def _sketches(vectors: np.ndarray) -> np.ndarray:
    planes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], BITS))
    return np.packbits(vectors @ planes > 0, axis=1).view(np.uint64)


# --- building -------------------------------------------------------------------------------


def _train(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit vectors by repeated means; an empty one starts again from the vector that fits worst."""
    centroids = vectors[:lists].copy()
    for _ in range(TURNS):
        scores = vectors @ centroids.T
        nearest = scores.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        empty = np.flatnonzero(np.bincount(nearest, minlength=lists) == 0)
        if len(empty):
            sums[empty] = vectors[np.argsort(scores.max(axis=1), kind="stable")[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def _probes(vectors: np.ndarray, centroids: np.ndarray) -> int:
    """Lists a query must look into to meet COVERAGE of its nearest neighbours, on a part of the sample."""
    asked = vectors[:: max(1, len(vectors) // 512)]
    at = np.arange(len(vectors))[:: max(1, len(vectors) // 512)]
    scores = asked @ vectors.T
    scores[np.arange(len(at)), at] = -np.inf
    k = min(NEIGHBOURS, len(vectors) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    held = (vectors @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.take_along_axis(place, held[near], axis=1)
    return int(np.quantile(ranks, COVERAGE, method="inverted_cdf")) + 1


def fit(dense: DataFrame) -> DataFrame:
    """centroids(kb_id, list, centroid, probes) of dense(kb_id, child_id, embedding)."""
    sizes = dense.groupBy("kb_id").agg(F.count("*").alias("_rows"))
    keyed = dense.select("kb_id", F.xxhash64("child_id").alias("_draw"), "child_id", F.col("embedding").cast("array<float>").alias("embedding"))
    sample = top_k(keyed, ["kb_id"], ["_draw", "child_id"], SAMPLE, "_place").join(sizes, "kb_id")
    schema = T.StructType.fromDDL("kb_id string, list int, centroid array<float>, probes int")
    arrow = to_arrow_schema(schema)

    def train(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        vectors = _matrix(rows["embedding"])
        lists = min(MOST_LISTS, len(vectors), max(1, round(rows["_rows"][0].as_py() ** 0.5)))
        centroids = _train(vectors, lists)
        return pa.Table.from_pydict({
            "kb_id": [rows["kb_id"][0].as_py()] * lists, "list": np.arange(lists, dtype=np.int32),
            "centroid": list(centroids.astype(np.float32)), "probes": np.full(lists, _probes(vectors, centroids), dtype=np.int32),
        }, schema=arrow)

    return sample.groupBy("kb_id").applyInArrow(train, schema)


HOME, PROBE, FIRST, REACH = "home", "probe", "first", "reach"


def _near_lists(rows: DataFrame, key: str, centroids: DataFrame, columns: str, which: str, limit: int = 0) -> DataFrame:
    """`rows` with lists.

    HOME gives the number and angle of the nearest list and the row's sketch, PROBE all lists that a
    query must look into to be likely right, FIRST the nearest few, REACH all that may hold a vector
    whose score is at least the row's `reach`. Of many lists, those of one `part` share a row, so a
    vector is repeated per part, not per list. `nths` are the places of the first of these lists,
    as far as they are below 2 * limit.

    Rows of a base are dealt into slices of about TILE / 10, and each slice gets the base's centroids.
    """
    found = "list int, angle double, sketch binary" if which == HOME else "part int, lists array<smallint>, nths array<smallint>"
    schema = T.StructType.fromDDL(f"kb_id string, {found}, {columns}, embedding array<float>")
    arrow = to_arrow_schema(schema)
    kept = [f.name for f in schema.fields if f.name not in ("list", "angle", "part", "lists", "nths", "sketch")]
    slices = rows.groupBy("kb_id").agg(F.ceil(F.count("*") / max(1, TILE // 10)).cast("int").alias("_slices"))
    dealt = rows.select(*kept).join(slices, "kb_id").withColumn("_slice", F.pmod(F.xxhash64(key), F.col("_slices")).cast("int")).drop("_slices")
    spread = centroids.join(slices, "kb_id").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")

    def find(held: pa.Table, near: pa.Table) -> pa.Table:
        if not held.num_rows or not near.num_rows:
            return arrow.empty_table()
        near = near.sort_by("list")
        vectors = _matrix(held["embedding"])
        scores = vectors @ np.vstack(near["centroid"].to_numpy()).astype("float64").T
        angles = np.arccos(np.clip(scores, -1.0, 1.0))
        if which == REACH:
            best = np.cos(np.maximum(angles - near["radius"].to_numpy(), 0.0))
            row, lists = np.nonzero(best >= held["reach"].to_numpy()[:, None] - SLACK)
            nth = np.zeros(len(row), dtype=int)
        else:
            wanted = 1
            if which != HOME:
                wanted = min(near["probes"][0].as_py(), scores.shape[1])
            if which == FIRST:
                wanted = min(wanted, max(FIRST_LISTS, math.ceil(FIRST_ROWS * limit / pc.mean(near["rows"]).as_py())))
            lists = np.argsort(-scores, axis=1, kind="stable")[:, :wanted].ravel()
            row, nth = np.repeat(np.arange(len(vectors)), wanted), np.tile(np.arange(wanted), len(vectors))
        out, number = held.select(kept), near["list"].to_numpy()[lists]
        if which == HOME:
            out = out.append_column("sketch", pa.array([c.tobytes() for c in _sketches(vectors)], pa.binary()))
            out = out.take(pa.array(row)).append_column("list", pa.array(number)).append_column("angle", pa.array(angles[row, lists]))
            return out.select(arrow.names).cast(arrow)
        part = near["part"].to_numpy()[lists]
        order = np.lexsort((nth, part, row))
        row, part, number, nth = row[order], part[order], number[order], nth[order]
        firsts = np.flatnonzero(np.r_[len(row) > 0, (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
        ends = pa.array(np.r_[firsts, len(row)], pa.int32())
        out = out.take(pa.array(row[firsts])).append_column("part", pa.array(part[firsts]))
        out = out.append_column("lists", pa.ListArray.from_arrays(ends, pa.array(number, pa.int16())))
        low = (nth < 2 * limit) & (which == PROBE)
        ends = pa.array(np.r_[0, np.cumsum(low)][np.r_[firsts, len(row)]], pa.int32())
        out = out.append_column("nths", pa.ListArray.from_arrays(ends, pa.array(nth[low], pa.int16())))
        return out.select(arrow.names).cast(arrow)

    return dealt.groupBy("kb_id", "_slice").cogroup(spread.groupBy("kb_id", "_slice")).applyInArrow(find, schema)


def build(dense: DataFrame) -> Lists:
    """The lists of dense(kb_id, parent_id, child_id, embedding)."""
    dense = dense.where(F.size("embedding") > 0).withColumn("embedding", F.col("embedding").cast("array<float>"))
    centroids = materialize(fit(dense), "centroids")
    columns = ", ".join(f"{c} {dense.schema[c].dataType.simpleString()}" for c in ("parent_id", "child_id"))
    vectors = materialize(_in_order(_near_lists(dense, "child_id", centroids, columns, HOME)), "lists")
    sizes = vectors.groupBy("kb_id", "list").agg(F.max("angle").alias("radius"), F.count("*").alias("rows"))
    return Lists(materialize(centroids.join(sizes, ["kb_id", "list"]), "centroids"), vectors.drop("angle"))


# --- searching ------------------------------------------------------------------------------


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _bits(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(codes.view(np.uint8), axis=1).astype(np.float32)


FIELD = 4 * BITS  # two numbers up to BITS, of any sign, share a float: a matrix product counts for two rows at once


def _sides(codes: np.ndarray) -> np.ndarray:
    """The bits of the first half of the sketches, and FIELD times those of the other half."""
    half = (len(codes) + 1) // 2
    out = _bits(codes[:half])
    out[: len(codes) - half] += FIELD * _bits(codes[half:])
    return out


def _alike(signs: np.ndarray, sides: np.ndarray, n: int) -> np.ndarray:
    """For every query, how little the `n` sketches of `sides` differ from its own, up to a constant.

    `signs` are 1 for a bit set and -1 otherwise. The numbers are whole and below 2 ** 24, so exact.
    """
    out, half = np.empty((len(signs), 2 * len(sides)), dtype=np.float32), len(sides)
    both, other = out[:, :half], out[:, half:]
    summed = signs @ sides.T
    np.rint(np.multiply(summed, np.float32(1 / FIELD), out=other), out=other)
    np.subtract(summed, np.multiply(other, np.float32(FIELD), out=both), out=both)
    return out[:, :n]


def _places(asked: pa.Table, lists: np.ndarray, most: int) -> np.ndarray:
    """Per query and list (of the sorted `lists`): 0 if not asked for, else its place from 1, `most` + 1 for later ones."""
    arrays = [asked[c].combine_chunks() for c in ("lists", "nths")]
    sizes, low = (pc.list_value_length(x).to_numpy() for x in arrays)
    owner, number = np.repeat(np.arange(len(sizes)), sizes), arrays[0].flatten().to_numpy()
    place = np.full(len(number), most + 1, dtype=np.int32)
    starts = np.cumsum(sizes) - sizes
    place[np.arange(low.sum()) + np.repeat(starts - (np.cumsum(low) - low), low)] = arrays[1].flatten().to_numpy() + 1
    at = np.minimum(np.searchsorted(lists, number), len(lists) - 1)
    here = lists[at] == number
    out = np.zeros((len(sizes), len(lists)), dtype=np.int32)
    out[owner[here], at[here]] = place[here]
    return out


def _meet(asked: pa.Table, held: pa.Table, group: str, limit: int, every: bool, counted: Accumulator | None) -> pa.Table:
    """The rows (sorted by `group`) among a query's best in its lists, of all or of those whose sketches are nearest."""
    floor = asked["reach"].to_numpy() if "reach" in asked.column_names else None
    best = Best(_matrix(asked["embedding"]), held, group, limit, floor)
    wanted, vectors = best.queries.astype(np.float32), best.vectors.astype(np.float32)
    distinct = np.zeros(len(vectors), dtype=bool)
    distinct[best.distinct()] = True
    lists = held["list"].to_numpy()
    numbers = np.unique(lists)
    places = _places(asked, numbers, 2 * limit)
    order = np.argsort(lists, kind="stable")
    members = np.split(order, np.searchsorted(lists[order], numbers[1:]))
    if every:
        members = [rows[distinct[rows]] for rows in members]
    else:
        asked_codes, codes = _sketches(best.queries), _codes(held["sketch"])
        sides = [_sides(codes[rows]) for rows in members]
    near = [vectors[rows] for rows in members]
    alone = len(np.unique(best.group)) == len(best.group)
    blocks = []  # lists, rows and where a list's rows are among them
    ends = np.cumsum([len(rows) for rows in members])
    for block in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff((ends - 1) // LISTS_BLOCK)) + 1):
        rows = np.concatenate([members[n] for n in block])
        columns = [np.arange(ends[n] - len(members[n]), ends[n]) - (ends[block[-1]] - len(rows)) for n in block]
        if not alone:  # side by side, of several lists
            rows = np.sort(rows)
            columns = [np.searchsorted(rows, members[n]) for n in block]
        if len(rows):
            blocks.append((block, rows, columns))
    products, step = 0, max(1, BLOCK_CELLS // max((len(rows) for _, rows, _ in blocks), default=1))
    for start in range(0, len(wanted), step):
        signs = None if every else 2 * _bits(asked_codes[start : start + step]) - 1
        for block, rows, columns in blocks:
            asking = start + np.flatnonzero(places[start : start + step, block].any(axis=1))
            if not len(asking):
                continue
            scores = np.full((len(asking), len(rows)), -np.inf, dtype=np.float32)
            for n, column in zip(block, columns, strict=True):
                to = np.flatnonzero(places[asking, n])
                mine = asking[to]
                if not len(to) or not len(column):
                    continue
                if every:
                    scores[(to, slice(column[0], column[-1] + 1)) if alone else np.ix_(to, column)] = wanted[mine] @ near[n].T
                    products += len(to) * len(column)
                    continue
                rest = np.minimum(2 * limit // places[mine, n] + LEAST_KEPT + int(SHARE_KEPT * len(column)), len(column))
                alike = _alike(signs[mine - start], sides[n], len(column))
                least = np.empty(len(to), dtype=np.float32)
                for k in np.unique(rest).tolist():
                    same = rest == k
                    least[same] = np.partition(alike[same], len(column) - k, axis=1)[:, len(column) - k]
                kept = alike >= least[:, None]
                if not distinct[members[n]].all():
                    kept &= distinct[members[n]]
                cells = np.flatnonzero(kept)
                by, at = np.divmod(cells, len(column))
                of = np.repeat(wanted[mine], np.bincount(by, minlength=len(to)), axis=0)
                scores[to[by], column[at]] = np.einsum("ij,ij->i", of, near[n].take(at, axis=0))
                products += len(cells)
            best.look(asking, rows, scores)
    if counted is not None:
        counted.add(products)
    return best.found(asked, held)


def _most(n: Column, length: Column, tile: int, spread: int) -> Column:
    """Rows of a tile of `n` in all: so that all cores are busy, but not below LEAST_TILE nor beyond TILE_BYTES."""
    return F.greatest(F.lit(min(tile, LEAST_TILE)), F.least(F.ceil(n / spread), F.floor(TILE_BYTES / (4 * length)))).cast("long")


def _spread(df: DataFrame) -> int:
    return math.ceil((GROUPS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism) ** 0.5)


def _parted(centroids: DataFrame) -> DataFrame:
    """Neighbouring lists of a base as parts of a tile of rows or so; a longer list is a part of its own or ends one."""
    base = Window.partitionBy("kb_id")
    before = F.coalesce(F.sum("rows").over(base.orderBy("list").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tile = _most(F.sum("rows").over(base), F.size("centroid"), TILE, _spread(centroids))
    return centroids.withColumn("part", F.floor(before / tile).cast("int"))


def search(queries: DataFrame, lists: Lists, limit: int, per_parent: bool = False, counted: Accumulator | None = None) -> DataFrame:
    """Nearest children of queries(query_id, kb_id, embedding), as search.dense_search but approximate.

    `counted` adds up the dot products with stored vectors.
    """
    vectors = queries.where(F.size("embedding") > 0).withColumn("embedding", F.col("embedding").cast("array<float>"))
    asked = _near_lists(vectors, "query_id", _parted(lists.centroids), _kind(queries), PROBE, limit)
    return _looked_into(asked, lists, limit, per_parent, False, counted)


def exact(queries: DataFrame, lists: Lists, limit: int, per_parent: bool = False, counted: Accumulator | None = None) -> DataFrame:
    """As search.dense_search, without the lists that cannot hold a result."""
    vectors = queries.where(F.size("embedding") > 0).withColumn("embedding", F.col("embedding").cast("array<float>"))
    nearest = _near_lists(vectors, "query_id", _parted(lists.centroids), _kind(queries), FIRST, limit)
    first = _looked_into(nearest, lists, limit, per_parent, True, counted).where(F.col("rank") == limit)
    known = vectors.join(first.select("query_id", F.col("score").alias("reach")), "query_id", "left")
    known = known.withColumn("reach", F.coalesce("reach", F.lit(-2.0)))  # too few found: every list
    asked = _near_lists(known, "query_id", _parted(lists.centroids), f"{_kind(queries)}, reach double", REACH)
    return _looked_into(asked, lists, limit, per_parent, True, counted)


def _kind(queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}"


def _looked_into(asked: DataFrame, lists: Lists, limit: int, per_parent: bool, every: bool, counted: Accumulator | None) -> DataFrame:
    """The best rows of the lists that each query is sent to."""
    group = "parent_id" if per_parent else "child_id"
    asked = materialize(asked, "probes")
    keys = ["kb_id", "part"]
    rows = lists.vectors.join(F.broadcast(_parted(lists.centroids).select(*keys, "list")), ["kb_id", "list"])
    if every:
        rows = rows.drop("sketch")
    # a unit is a tile of the rows of some lists against a tile of the queries sent to any of them
    length, n = F.max(F.size("embedding")), F.count("*")
    sized = lambda df, name, tile: df.groupBy(*keys).agg(F.ceil(n / tile).cast("int").alias(name))
    tiles = sized(rows, "_r", 2 * F.greatest(F.lit(TILE), F.floor(TILE_BYTES / (4 * length))))
    tiles = tiles.join(sized(asked, "_q", _most(n, length, TILE, _spread(asked))), keys)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    asked = asked.join(tiles, keys).withColumn("_qt", mine("query_id", "_q")).withColumn("_rt", each("_r")).drop("_q", "_r")
    held = rows.join(tiles, keys).withColumn("_rt", mine("child_id", "_r")).withColumn("_qt", each("_q")).drop("_q", "_r")
    schema = _found_schema(asked, lists.vectors)
    arrow = to_arrow_schema(schema)

    def meet(block: pa.Table, part: pa.Table) -> pa.Table:
        if not block.num_rows or not part.num_rows:
            return arrow.empty_table()
        return _meet(block, part.sort_by(group), group, limit, every, counted).select(arrow.names).cast(arrow)

    unit = [*keys, "_qt", "_rt"]
    return _ranked(asked.groupBy(*unit).cogroup(held.groupBy(*unit)).applyInArrow(meet, schema), limit, per_parent)
