"""Importance resampling of documents towards a target text collection, by hashed word runs.

Features are all runs of 1 to `LONGEST` consecutive words, hashed into `BUCKETS` buckets. A bucket's
gain is the logarithm of how much more common it is among the target's texts than among the
documents; a document's weight is the sum of its features' gains. Adding Gumbel noise, fixed by a
hash of the document's key, to the weights and taking the highest scores draws documents without
replacement in proportion to their importance.

Texts of a batch are joined with a separator that no word holds, so that one pass of one pattern
finds the words of all of them. A binary search of the words' places among the documents' offsets
tells whose they are; a run whose first and last word have different owners crosses documents and
is masked before `bincount` adds up. Hashes of longer runs continue those of shorter ones. Words
come off the pattern in blocks of `BLOCK`, the last words' hashes being carried on, so a very long
text needs no more memory than its bytes and one block.

Each task adds up its own buckets, so what is shuffled and sent to the driver is `BUCKETS` numbers
per side. Ranks come from a range exchange on (score, key), not from one sorted task.

Defined results: a null or empty text has no features and weight 0; a very long text counts whole;
a null key draws its noise as an empty key would; equal scores go to the smaller key, null keys
last, and rows alike in key and text are documents of their own with ranks side by side; without
documents the result is empty, without target texts all counts of the target are 0. Extra columns,
whatever their names, pass through `drawn` untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.mixing import numbered
from tidemark.llm.text import packed, small_batches
from tidemark.llm.words import slices
from tidemark.plans.skew import materialize

BUCKETS = 10_000
LONGEST = 3
SHARE = 5  # per cent of the documents that are long enough
LEAST_WORDS = 20
SEED = "42"
BLOCK = 1 << 17

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # in lower-cased UTF-8: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
SEPARATOR = b"\n"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def grams(texts: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, list]]:
    """Blocks of words in order: each word's text, and for each length the bucket and owner of the runs that end there."""
    joined = SEPARATOR.join(texts).translate(LOWER)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offsets = np.cumsum(sizes + len(SEPARATOR)) - sizes - len(SEPARATOR)
    found = WORD.finditer(joined)
    # of the last words before a block: their texts' numbers, and the hash of the run of each length ending at the last
    owners, hashes = np.full(longest - 1, -1, dtype=np.int64), [0] * (longest - 1)
    while True:
        block = list(islice(found, BLOCK))
        if not block:
            return
        words = [m[0] for m in block]
        starts = np.fromiter((m.start() for m in block), dtype=np.int64, count=len(block))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        known = np.concatenate([owners, owner])
        codes = [list(map(crc32, words))]
        spaced = [b" " + w for w in words]
        for n in range(1, longest):  # a run's hash goes on from that of its words but the last
            codes.append(list(map(crc32, spaced, chain([hashes[n - 1]], codes[-1]))))
        runs = []
        for n in range(longest):
            inside = known[longest - 1 - n : len(known) - n] == owner
            bucket = np.array(codes[n], dtype=np.int64) % buckets
            runs.append((bucket[inside], owner[inside]))
        yield owner, runs
        owners = known[len(known) - (longest - 1) :] if longest > 1 else owners
        hashes = [codes[n][-1] for n in range(longest - 1)]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: features of all texts, added up within tasks first."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for part in (p for b in batches for p in slices(b, "text")):
            for _, runs in grams(_texts(part), buckets, longest):
                for bucket, _ in runs:
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """A whole number per bucket: thousandths of the log ratio of its shares, each count plus one."""

    def dense(df: DataFrame, column: str) -> list[int]:
        held = [0] * buckets
        for bucket, n in bucket_counts(df, column, buckets, longest).collect():  # `buckets` rows at most
            held[bucket] = n
        return held

    mine, theirs = dense(docs, text), dense(target, target_text)
    own, other = sum(mine) + buckets, sum(theirs) + buckets
    ratio = [((t + 1) * own) / ((s + 1) * other) for s, t in zip(mine, theirs)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise(key: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel draw, fixed by the key."""
    digits = F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """Per row: id, version (a hash of the text), n_words, n_features, weight."""
    schema = T.StructType().add("id", docs.schema[key].dataType)
    for name in ("version", "n_words", "n_features", "weight"):
        schema = schema.add(name, T.LongType())

    def run(batches):
        for part in (p for b in batches for p in slices(b, "text")):
            n = part.num_rows
            words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for owner, runs in grams(_texts(part), len(gain), longest):
                words += np.bincount(owner, minlength=n)
                for bucket, of in runs:
                    features += np.bincount(of, minlength=n)
                    weight += np.bincount(of, weights=gain[bucket], minlength=n).astype(np.int64)  # exact below 2 ** 53
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("version"), pa.array(words), pa.array(features), pa.array(weight)], names=schema.names
            )

    small_batches(docs.sparkSession)
    held = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.col(f"`{text}`").alias("text"))
    return held.mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS, longest: int = LONGEST,
) -> DataFrame:
    """Per row: id, version, n_features, weight, score, rank (from 1; null where not drawn).

    Drawn are the `share` per cent of highest scores among the rows of `least_words` words or more.
    """
    gain = gains(docs, target, text, target_text, buckets, longest)
    scored = weighed(docs, gain, key, text, longest).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = materialize(scored, "importance")
    able = F.col("n_words") >= least_words
    size = share * scored.where(able).count() // 100
    ranked = numbered(scored.where(able).withColumn("_minus", -F.col("score")), "_minus", "id", "version").drop("_minus")
    rank = F.when(F.col("place") < size, F.col("place") + 1).cast("long")
    columns = ["id", "version", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents drawn, with their own columns.

    Of rows alike in key and text a part may be drawn, those with the last rank; only such rows are
    told apart by a window.
    """
    found = resample(docs, target, key, text, **options)
    per_text = found.groupBy("id", "version").agg(F.count("rank").alias("n"), F.count("*").alias("m")).where("n > 0")
    per_text = materialize(per_text.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "n", "m"), "drawn")
    keyed = packed(docs, id=F.col(f"`{key}`"), version=F.xxhash64(F.col(f"`{text}`")))
    joined = keyed.join(per_text, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    nth = F.row_number().over(Window.partitionBy("id", "version").orderBy(F.xxhash64("_row")))
    part = joined.where("n < m").withColumn("nth", nth).where("nth <= n")
    return joined.where("n = m").select("_row.*").unionByName(part.select("_row.*"))
