"""Mixing sources to target weights by Pareto order sampling.

A source's target words are given; every document of it should appear target / size times on
average. The whole part of that number is taken for certain as whole copies. For the rest f each
document gets an inclusion probability (f, or in proportion to a weight column), and documents are
ranked by random odds over inclusion odds, u / (1 - u) over p / (1 - p). The sample is the head of
that ranking, its size being fixed in words: documents are taken up to the first that would exceed
the target; further sweeps go on down the ranking among those small enough for what is left, until
none fits. What a sweep leaves is less than the document it stopped at, so a few do.

u is a hash of the document's key, so reruns agree. The ranking is a running sum over a source that
may hold a third of all rows: it is cut into ranges of rank, as many as the root of its rows, summed
per range, and carried on over the range totals.

Defined results: a very long text counts whole, like any other; a null text has size 0 and is taken as often as the whole copies say; sources sort
by code point, null last and a source like any other; rows of equal key and text are documents of
their own that rank side by side; an empty table gives an empty result; extra columns pass through
`mixed` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import packed, spaced_words
from tidemark.plans.skew import materialize

WEIGHTS = (5.0, 2.0, 1.0)  # by a source's place, repeating
SHARE = 1.5
MOST = 2.0  # times a source's size
BITS = 52


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds `place`, from 0, in ascending order with nulls last, without one task for all rows."""
    parts = df.repartitionByRange(*[F.asc_nulls_last(c) for c in order]).withColumn("_part", F.spark_partition_id())
    parts = materialize(parts, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.asc_nulls_last(c) for c in order]))
    return parts.join(sizes, "_part").withColumn("place", F.col("_before") + inner - 1).drop("_part", "_before")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to one row per source (source, source_size, place).

    Weights share `share` times all words. A target above `most` times its source stops there and
    the excess is shared again by weight among the others, until none is above. Each turn is one
    aggregate whose two sums come back.
    """
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    held = materialize(sizes.withColumn("weight", pick), "sources")
    total = float(held.agg(F.sum("source_size")).head()[0] or 0) * share
    rate = F.lit(0.0)
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= most * F.col("source_size")
        taken, free = held.agg(
            F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))
        ).head()
        if not free:
            rate = F.lit(float("inf"))
            break
        following = (total - (taken or 0.0)) / free
        rate = F.lit(following)
        if following <= level:
            break
        level = following
    wanted = F.when(F.col("weight") * rate >= most * F.col("source_size"), most * F.col("source_size")).otherwise(F.col("weight") * rate)
    return held.withColumn("target", wanted.cast("double")).drop("weight", "place")


def uniform(key: Column, seed: str) -> Column:
    """A fixed draw in (0, 1) for each key, of `BITS` bits."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("-")))), 1, BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**BITS)


def _head(rows: DataFrame) -> DataFrame:
    """`row` of the head of each source's ranking that fits into `room`."""
    inner = Window.partitionBy("source", "range").orderBy("rank", "id", "version", "row").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "range").agg(F.sum("size").alias("_sum"))
    totals = totals.select(
        F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before")
    )
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))
    summed = rows.withColumn("_inner", F.sum("size").over(inner)).join(totals, on)
    return summed.where(F.col("_inner") + F.col("_before") <= F.col("room")).select("row", "source", "size")


def copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, seed: str = "mix"
) -> DataFrame:
    """Per row: id, version, source, size, source_size, target, copies, taken (words, size * copies).

    `weight` names a column of relative odds within a source; without it all documents of a source
    have the same probability, which still differs from source to source.
    """
    odds = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    slim = docs.select(
        F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.col(f"`{source}`").alias("source"),
        F.size(spaced_words(F.col(f"`{text}`"))).cast("long").alias("size"), odds.alias("odds"),
        F.monotonically_increasing_id().alias("row"),
    )
    slim = materialize(slim, "sizes")
    sizes = slim.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.sum(F.col("odds") * F.col("size")).alias("odds_size")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = targets(numbered(sizes, "source")).withColumn("whole", F.floor(rate))
    aims = aims.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    aims = materialize(aims.withColumn("ranges", F.ceil(F.sqrt("rows"))).withColumnRenamed("source", "_source"), "targets")
    rows = slim.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    held = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))  # noqa: E731  odds have no value at 0 and 1
    even = held(F.coalesce(F.col("rest") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.5)))
    p = held(F.coalesce(F.col("rest") * F.col("odds") / F.nullif(F.col("odds_size"), F.lit(0.0)), F.lit(0.5)))
    u = uniform(F.col("id"), seed)
    rows = rows.withColumn("rank", (u / (1 - u)) / (p / (1 - p)))
    # ranges of rank: cut where equal probabilities would make them ranges of u, which spreads evenly
    level = F.col("rank") * (even / (1 - even))
    rows = rows.withColumn("range", F.least(F.floor(level / (1 + level) * F.col("ranges")), F.col("ranges") - 1))
    rows = materialize(rows.drop("odds", "odds_size", "rows", "ranges"), "ranked")

    picked = rows.where("false").select("row", "source", "size")
    while True:
        got = picked.groupBy("source").agg(F.sum("size").alias("_got")).withColumnRenamed("source", "_source")
        room = F.col("rest") - F.coalesce("_got", F.lit(0))
        left = rows.where("rest >= 1 AND size > 0").join(picked.select("row"), "row", "left_anti")
        left = left.join(got, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("room", room).where("size <= room")
        head = materialize(_head(left.select("row", "id", "version", "source", "size", "rank", "range", "room")), "head")
        if head.isEmpty():
            break
        picked = materialize(picked.unionByName(head), "picked")
    # one document more where that brings a source nearer to its target
    got = picked.groupBy("source").agg(F.sum("size").alias("_got")).withColumnRenamed("source", "_source")
    left = rows.where("rest >= 1 AND size > 0").join(picked.select("row"), "row", "left_anti")
    left = left.join(got, F.col("source").eqNullSafe(F.col("_source")), "left").where("size < 2 * (rest - coalesce(_got, 0))")
    last = left.groupBy("source").agg(F.min(F.struct("rank", "id", "version", "row")).alias("x")).select(F.col("x.row").alias("row"))
    picked = materialize(picked.select("row").unionByName(last), "picked")
    extra = rows.join(picked.select("row", F.lit(1).alias("more")), "row", "left")
    n = F.col("whole") + F.coalesce("more", F.lit(0))
    return extra.select(
        "id", "version", "source", "size", "source_size", "target", n.cast("long").alias("copies"), (F.col("size") * n).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    per_text = copies(docs, key, text, source, weight).groupBy("id", "version").agg(F.sum("copies").alias("n"), F.count("*").alias("m"))
    per_text = per_text.where("n > 0").select(F.col("id").alias("_id"), F.col("version").alias("_version"), "n", "m")
    keyed = packed(docs, id=F.col(f"`{key}`"), version=F.xxhash64(F.col(f"`{text}`")))
    joined = keyed.join(per_text, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    # of rows alike in key and text each takes its part; only those whose parts differ are told apart by a window
    even = joined.where("n % m = 0").withColumn("times", (F.col("n") / F.col("m")).cast("int"))
    nth = F.row_number().over(Window.partitionBy("id", "version").orderBy(F.xxhash64("_row")))
    uneven = joined.where("n % m > 0").withColumn("times", (F.floor(F.col("n") / F.col("m")) + (nth <= F.col("n") % F.col("m")).cast("int")).cast("int"))
    taken = even.select("_row", "times").unionByName(uneven.where("times > 0").select("_row", "times"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")
