"""Joins and windows that hold when one key has a third of all rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 * 1024 * 1024
BLOCK_ROWS = 200_000  # rows of a key that one task may scan
MOST_BLOCKS = 1024  # of one key; beyond, blocks grow
DRAWN = 32  # rows of the sample in a block
STRIDE = 32


# --- written tables -------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Only a local master may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def written_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie, in the shared folder."""
    return os.path.join(shared_folder(spark), f"tidemark-{spark.sparkContext.applicationId}")


def drop_written(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(written_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back, so lost executors cost no recompute.

    Tables that hold whole texts take a quarter less room with `zstd`.
    """
    path = os.path.join(written_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for an input that arrives in fewer parts than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


# --- joins ----------------------------------------------------------------------------------
#
# Joins on keys that may be hot are plain joins: each side is shuffled once, and adaptive execution
# measures what was written, sends a side that turned out small to all tasks, and splits the
# partitions of hot keys.


def _bytes_of(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 16
    return F.lit(8)


def small_enough(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure the side that may be broadcast; a single aggregate, nothing is collected."""
    row = F.lit(16)
    for field in df.schema.fields:
        row = row + _bytes_of(field)
    measured = df.agg(F.sum(row.cast("long"))).head()[0]
    return (measured or 0) <= max_bytes


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of each group; each task cuts its own rows before the shuffle.

    A column named with a leading minus sorts downwards.
    """
    sorting = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    window = Window.partitionBy(*by).orderBy(*sorting)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


# --- ordered scans over long groups ---------------------------------------------------------


class Ordered:
    """Rows in a unique ascending `order` within `keys`, for scans along it; nulls come first.

    A plain window puts a key's rows into one task. Here keys are counted first. Keys of more than
    BLOCK_ROWS rows are cut into blocks of about so many consecutive rows, at bounds taken from a
    sample of their order; a scan then runs within blocks, all over the cluster, and carries one
    summary per block along the blocks of its key. Rows are shuffled once, by key and block. Where
    no key is long, as usual, scans are plain windows.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_ROWS)
        self.cut = bool(sizes.head(1))
        self.rows = self._blocked(rows, materialize(sizes, "long_keys")) if self.cut else rows

    def _blocked(self, rows: DataFrame, sizes: DataFrame) -> DataFrame:
        """Adds `_block`, ascending along the order of a long key and null for other keys."""
        moment = F.struct(*self.order)
        rate = F.floor(F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.col("_n") / MOST_BLOCKS)) / DRAWN)
        long = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in self.keys], F.greatest(rate, F.lit(1)).alias("_rate"))
        drawn = rows.select(*self.keys, *[c for c in self.order if c not in self.keys]).join(long, self._same("_of_"))
        drawn = drawn.where(F.pmod(F.xxhash64(*self.order), "_rate") == 0).groupBy(*self.keys)
        sample = drawn.agg(F.array_sort(F.collect_list(moment)).alias("_sample"))  # DRAWN * MOST_BLOCKS values, or so
        bounds = F.filter("_sample", lambda _, i: i % DRAWN == DRAWN - 1)
        bounds = materialize(sample.select(*[F.col(k).alias(f"_of_{k}") for k in self.keys], bounds.alias("_bounds")), "bounds")
        # blocks before a row's: whole strides first, then one by one
        strides = F.size(F.filter("_bounds", lambda b, i: (i % STRIDE == STRIDE - 1) & (b <= moment)))
        rest = F.size(F.filter(F.slice("_bounds", strides * STRIDE + 1, F.lit(STRIDE)), lambda b: b <= moment))
        block = F.when(F.col("_bounds").isNotNull(), strides * STRIDE + rest)
        return rows.join(bounds, self._same("_of_"), "left").select(*rows.columns, block.alias("_block"))

    def _same(self, prefix: str) -> Column:
        on = F.lit(True)
        for key in self.keys:
            on = on & F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
        return on

    def _window(self):
        return Window.partitionBy(*self.keys, *(["_block"] if self.cut else [])).orderBy(*self.order)

    def _with(self, rows: DataFrame) -> Ordered:
        following = object.__new__(Ordered)
        following.keys, following.order, following.cut, following.rows = self.keys, self.order, self.cut, rows
        return following

    def _carried(self, summary: Column, over: Callable[[WindowSpec], Column]) -> DataFrame:
        """The rows with `_carried`: `over` of the summaries of the blocks of a long key."""
        blocks = self.rows.where("_block IS NOT NULL").groupBy(*self.keys, "_block").agg(summary.alias("_summary"))
        names = [F.col(c).alias(f"_at_{c}") for c in (*self.keys, "_block")]
        blocks = blocks.select(*names, over(Window.partitionBy(*self.keys).orderBy("_block")).alias("_carried"))
        return self.rows.join(blocks, self._same("_at_") & F.col("_block").eqNullSafe(F.col("_at__block")), "left").drop(
            *[f"_at_{c}" for c in (*self.keys, "_block")]
        )

    def column(self, name: str, value: Column) -> Ordered:
        return self._with(self.rows.withColumn(name, value))

    def total(self, value: str, out: str) -> Ordered:
        """Sum of `value` up to and including each row."""
        inner = F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0))
        if not self.cut:
            return self.column(out, inner)
        before = lambda w: F.sum("_summary").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = self._carried(F.sum(value), before)
        summed = F.coalesce(inner + F.coalesce("_carried", F.lit(0)), "_carried")
        return self._with(rows.withColumn(out, summed).drop("_carried"))

    def max_before(self, value: str, out: str) -> Ordered:
        """Largest `value` among the rows strictly before each row."""
        inner = F.max(value).over(self._window().rowsBetween(Window.unboundedPreceding, -1))
        if not self.cut:
            return self.column(out, inner)
        before = lambda w: F.max("_summary").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = self._carried(F.max(value), before)
        return self._with(rows.withColumn(out, F.greatest(inner, "_carried")).drop("_carried"))

    def previous(self, value: str, out: str) -> Ordered:
        """`value` of the row just before each row, NULL for the first row of a key."""
        if not self.cut:
            return self.column(out, F.lag(value).over(self._window()))
        held = F.struct(F.col(value).alias("v"))
        last = F.max_by(held, F.struct(*self.order))
        rows = self._carried(last, lambda w: F.lag("_summary").over(w))
        inner = F.lag(held).over(self._window())
        return self._with(rows.withColumn(out, F.coalesce(inner, "_carried")["v"]).drop("_carried"))

    def done(self) -> DataFrame:
        return self.rows.drop("_block")
