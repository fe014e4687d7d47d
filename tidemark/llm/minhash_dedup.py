"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each document is the set of its distinct word shingles. Every permutation gives two signature
values, the smallest and the largest hash, so half as many hash evaluations are needed for a
signature of the same length; each value agrees between two documents with a chance equal to their
similarity. Values are cut into bands, and documents that share a band are candidates. There are as many
bands of 6 values as miss a pair at the threshold with a chance of 5e-6 at most: 26 at 0.85, 41 at 0.80.

Copies (equal sets) are folded into one class first. Then, without building all pairs of a bucket:

1. every class is checked against one pivot per bucket, the one with the smallest key, then in
   buckets of several components against the one with most links; confirmed links are joined to
   components;
2. buckets that still hold several components are searched exactly. A class whose set has too many
   shingles that no other contested class has cannot reach the threshold with any of them, and
   leaves. What remains is paired across components, bounded by size and by those counts, and
   every pair left is checked.

So each linked pair that shares a bucket is either checked or already in one component. Checks use
the full sets (64-bit shingle hashes).

Defined results: null, empty and wordless texts have an empty set, link with nothing and are kept.
Rows without a key take no part and are kept, with a null component. Rows of one key are told apart
by their text. Extra columns pass through `keep_one` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import packed, small_batches, unpacked
from tidemark.llm.words import SPACED, Splitter, draws, grams, mix, slices
from tidemark.plans.skew import materialize

SHINGLE = 5
PERCENT = 85
BANDS = 26
ROWS = 6  # values of a band, half of them smallest and half largest hashes
MISS = 5e-6  # chance that a pair at the threshold shares no band, at most
PEELS = 2
LINKS_PER_TASK = 100_000
BLOCK = 4096


def bands_for(percent: int, rows: int = ROWS) -> int:
    """How many bands a threshold needs so that a pair at it is missed with a chance of `MISS` at most."""
    apart = 1 - (percent / 100) ** rows
    return math.ceil(math.log(MISS) / math.log(apart)) if apart > 0 else 1


def shingle_sets(texts: pa.Array, splitter: Splitter, k: int = SHINGLE):
    """The sorted distinct shingle hashes of each text; all words as one when there are fewer than k."""
    words = splitter.words(texts)
    hashes = grams(words.hashes, k)
    for a, z in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if z - a >= k:
            yield np.unique(hashes[a : z - k + 1])
        else:
            yield grams(words.hashes[a:z], z - a) if z > a else words.hashes[:0]


def signature(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Smallest, then largest value under each permutation x -> mix-free affine map of 64 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(len(factors), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), BLOCK):
            values = shingles[i : i + BLOCK, None] * factors + terms
            np.minimum(low, values.min(axis=0), out=low)
            np.maximum(high, values.max(axis=0), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One key per band from every `bands`-th value; the band's number is part of the key."""
    rows = values.reshape(-1, bands)
    with np.errstate(over="ignore"):
        summed = (mix(rows) * (draws(len(rows), 41) | np.uint64(1))[:, None]).sum(axis=0, dtype=np.uint64)
        return mix(summed + np.arange(1, bands + 1, dtype=np.uint64))


def _set_key(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0].astype(np.int64))


def fingerprints(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, version (of the text), n_shingles, node (key of the set), bands."""
    if rows % 2:
        raise ValueError("a band takes as many smallest as largest values")

    def run(batches):
        splitter = Splitter(SPACED)
        permutations = bands * rows // 2
        factors, terms = draws(permutations, 5) | np.uint64(1), draws(permutations, 7)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                sizes, nodes, keys = [], [], []
                for shingles in shingle_sets(part.column("text"), splitter):
                    sizes.append(len(shingles))
                    nodes.append(_set_key(shingles) if len(shingles) else None)
                    keys.append(
                        band_keys(signature(shingles, factors, terms), bands).astype(np.int64) if len(shingles) else None
                    )
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("version"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "version", "n_shingles", "node", "bands"],
                )

    held = docs.select(
        F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.col(f"`{text}`").alias("text")
    )
    schema = T.StructType(held.schema.fields[:2]).add("n_shingles", T.LongType()).add("node", T.LongType()).add("bands", T.ArrayType(T.LongType()))
    return held.mapInArrow(run, schema)


def _sets(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """node and its shingles, for the documents in `ids`."""

    def run(batches):
        splitter = Splitter(SPACED)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                found = [s for s in shingle_sets(part.column("text"), splitter) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_key(s) for s in found], pa.int64()), pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    held = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return held.join(ids, "id", "left_semi").select("text").mapInArrow(run, "node long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            left, right = batch.column("left"), batch.column("right")
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([a.filter(linked), b.filter(linked)], names=["a", "b"])

    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: each linked node and the smallest node it reaches, by alternating large and small stars.

    Each round is a few aggregates and joins over the links, written to the shared folder. A star's
    hub is only ever a join key whose rows are spread by adaptive skew handling.
    """
    n = links.count()
    stars = _held(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct(), n, "links")
    before = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).head()
        if state == before or state[0] == 0:
            return stars.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
                stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            )
        before, n = state, state[0]
        both = stars.unionByName(stars.select(F.col("low").alias("high"), F.col("high").alias("low")))
        hub = both.groupBy("high").agg(F.min("low").alias("hub")).withColumn("hub", F.least("hub", "high"))
        large = both.where("low > high").join(hub, "high").select(F.col("low").alias("high"), F.col("hub").alias("low"))
        large = large.unionByName(hub.where("hub < high").select("high", F.col("hub").alias("low")))
        large = _held(large.where("high <> low").distinct(), n, "large_stars")
        hub = large.groupBy("high").agg(F.min("low").alias("hub"))
        small = large.join(hub, "high").where("low <> hub").select(F.col("low").alias("high"), F.col("hub").alias("low"))
        stars = _held(small.unionByName(hub.select("high", F.col("hub").alias("low"))).distinct(), n, "small_stars")


def _held(df: DataFrame, n: int, name: str) -> DataFrame:
    """Written by as many tasks as about `n` links need, however many partitions a shuffle has."""
    return materialize(df.coalesce(1 + n // LINKS_PER_TASK), name)


def _contested(members: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    mixed = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    return members.join(mixed.select("bucket"), "bucket")


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _pair(x: str, y: str):
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).alias("x")


def _hub_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Per bucket of several components, its member with most links against those of other components."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    rest = materialize(_contested(members).join(ends, "node", "left").withColumn("links", F.coalesce("links", F.lit(0))), "contested")
    hubs = rest.groupBy("bucket").agg(F.max(F.struct("links", "node", "root")).alias("hub"))
    others = rest.join(hubs, "bucket").where("root <> hub.root")
    return others.select(_pair("node", "hub.node")).select("x.*").distinct()


def _cross_pairs(members: DataFrame, classes: DataFrame, sets: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket in different components that could still reach the threshold.

    A pair comes out of the first bucket it shares only.
    """
    rest = materialize(_contested(members), "contested")
    for _ in range(PEELS):
        shingles = sets.join(rest.select("node").distinct(), "node").select("node", F.explode("shingles").alias("s"))
        alone = shingles.groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
        counted = rest.drop("alone").join(alone.groupBy("node").agg(F.count("*").alias("alone")), "node", "left")
        counted = counted.withColumn("alone", F.coalesce("alone", F.lit(0)))
        rest = materialize(_contested(counted.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))), "contested")
    rest = rest.join(classes.select("node", "bands"), "node").withColumn("met", F.slice("bands", F.lit(1), F.col("band")))
    used = ("node", "n", "alone", "root", "met")
    x = rest.select("bucket", *[F.col(c).alias(f"{c}_x") for c in used])
    y = rest.select("bucket", *[F.col(c).alias(f"{c}_y") for c in used])
    fits = 100 * F.least(F.expr("n_x - alone_x"), F.expr("n_y - alone_y")) >= percent * F.greatest(
        F.expr("n_x + alone_y"), F.expr("n_y + alone_x")
    )
    on = (x["bucket"] == y["bucket"]) & F.expr("node_x < node_y") & F.expr("root_x <> root_y") & fits & ~F.arrays_overlap("met_x", "met_y")
    pairs = x.join(y, on).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    return pairs.join(checked, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, version, n_shingles, component_id (smallest key reachable), kept."""
    small_batches(docs.sparkSession)
    rows = materialize(fingerprints(docs, key, text, bands_for(percent)), "fingerprints")
    classes = (
        rows.where("node IS NOT NULL AND id IS NOT NULL")
        .groupBy("node")
        .agg(F.min("id").alias("id"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"))
    )
    banded = materialize(classes, "classes")
    buckets = banded.select("node", "id", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.min(F.struct("id", "node"))["node"].alias("pivot"), F.count("*").alias("m"))
    shared = shared.where("m > 1").drop("m")
    members = materialize(buckets.join(shared, "bucket"), "members")
    ids = members.select("id").distinct()
    sets = materialize(_sets(docs, ids, key, text), "sets")

    pairs = materialize(members.where("node <> pivot").select(_pair("node", "pivot")).select("x.*").distinct(), "pairs")
    links = materialize(_confirmed(pairs, sets, percent), "confirmed")
    members = members.drop("pivot", "id")
    roots = components(links)
    more = materialize(_hub_pairs(_placed(members, roots), links).join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = materialize(links.unionByName(_confirmed(more, sets, percent)), "confirmed")
    roots = components(links)
    checked = pairs.unionByName(more)
    late = materialize(_confirmed(_cross_pairs(_placed(members, roots), banded, sets, checked, percent), sets, percent), "confirmed")
    if not late.isEmpty():
        roots = components(links.unionByName(late))

    linked = materialize(roots.join(banded.select("node", "id"), "node"), "linked")
    smallest = linked.join(linked.groupBy("root").agg(F.min("id").alias("smallest")), "root").select("node", "smallest")
    named = banded.select("node", "id").join(smallest, "node", "left").select("node", F.coalesce("smallest", "id").alias("component_id"))
    judged = rows.drop("bands").join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return judged.select("id", "version", "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with one of each group left: the smallest key's, and of its repeated rows one."""
    found = near_duplicates(docs, key, text, percent).where("id IS NOT NULL")
    # what is not simply kept: rows to go, and rows of equal key and text
    marks = found.groupBy("id", "version").agg(F.min("kept").alias("kept"), F.count("*").alias("m")).where("NOT kept OR m > 1")
    marks = materialize(marks.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "kept", "m"), "marks")
    keyed = packed(docs, id=F.col(f"`{key}`"), version=F.xxhash64(F.col(f"`{text}`")))
    joined = keyed.join(marks, (F.col("id") == F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    alone = joined.where("kept IS NULL").select("_row")
    once = joined.where("kept").dropDuplicates(["id", "version"]).select("_row")
    return unpacked(alone.unionByName(once))
