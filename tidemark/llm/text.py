"""Word rules as Column expressions, and helpers for rows whose columns may be named like ours."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ROW = "_row"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def spaced_words(text: Column) -> Column:
    """Words between white space; a null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def alnum_words(text: Column) -> Column:
    """Words of a-z, 0-9 and everything beyond ASCII, after lower-casing; a null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct beside `columns`, so that no extra column can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(f"{ROW}.*", *more)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lets no Arrow batch grow far beyond `size` bytes, whatever the number of rows; a session setting."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = str(spark.conf.get(name, None) or "")
    if not held.rstrip("bB").isdigit() or int(held.rstrip("bB")) > size:
        spark.conf.set(name, str(size))
