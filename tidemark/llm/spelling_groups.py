"""Spelling variants: words one edit apart, each pointing to a much more frequent one.

Two words are near when one inserted, deleted or replaced code point turns one into the other. That
is so exactly when they differ and their common prefix and suffix together reach the longer length
minus one, and their lengths differ by one at most. Words are rows of a matrix of code points,
padded behind for prefixes and before for suffixes, and blocks of rows meet in dense comparisons.

Which blocks meet: take a pair whose longer word has M code points, cut into `PARTS` parts. The edit
lies in one part, so the pair agrees on all before and all behind that part. A word therefore has
one key per part, for M equal to its length and for M one more: (M, part, what stands before, what
stands behind). Only words that share a key are compared, and a pair counts under the key whose part
holds the end of its common prefix, so it is found once. Keys of one word only are dropped after a
count. The words of a key with more than `TILE` are dealt into blocks by hash and every two blocks
are a unit of their own, so no task holds more than two blocks of a key, and the units of a hot key
spread over all tasks. No pair is built but the near ones.

A word's form is its near word with the largest count, if that is at least `TIMES` its own; counts
grow along forms, so following them ends. Roots are found by doubling: every turn looks up the form
of the form, log2 of the longest chain times.

Defined results: a null text has no words; a very long text or word counts whole; a null key takes
part in the noise as an empty one; rows of equal key and text count each; among near words of equal
count the first in code-point order is the form; no words give an empty result. Extra columns do
not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import small_batches
from tidemark.llm.words import slices
from tidemark.plans.skew import materialize

LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
PARTS = 3
TILE = 1024
CELLS = 1 << 24
DISTINCT = 300_000
ITSELF = 2

LETTERS = "a-zÀ-ÿ"  # after lower-casing A-Z alone
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# --- words ----------------------------------------------------------------------------------


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, noise: int | None = None) -> DataFrame:
    """word, n: runs of letters of `least` code points or more, A-Z lower-cased.

    With `noise`, a run whose checksum with its row's key is a multiple of it loses one code point
    first, at the checksum modulo its length: known misspellings at a known rate.
    """

    def run(batches):
        word = re.compile(f"[{LETTERS}]{{{least},}}")
        counts: Counter[str] = Counter()
        for part in (p for b in batches for p in slices(b, "text")):
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            for owner, raw in zip(part.column("id").to_pylist(), texts):
                words = word.findall((raw or b"").translate(LOWER).decode("utf-8", "replace"))
                if noise and words:
                    start = crc32(f"{'' if owner is None else owner}:".encode())
                    sums = np.fromiter(map(crc32, map(str.encode, words), repeat(start)), dtype=np.int64, count=len(words))
                    for i in np.flatnonzero(sums % noise == 0).tolist():
                        at = int(sums[i]) % len(words[i])
                        words[i] = words[i][:at] + words[i][at + 1 :]
                counts.update(words)
            if len(counts) > DISTINCT:
                yield emit(counts)
                counts.clear()
        yield emit(counts)

    def emit(counts: Counter) -> pa.RecordBatch:
        held = {w: n for w, n in counts.items() if len(w) >= least}
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# --- units of comparison --------------------------------------------------------------------


def _keyed(words: DataFrame, parts: int) -> DataFrame:
    """word, n, longer, part, low, high (bounds of the part), key: a row per part and length of the longer word."""
    size = F.length("word")
    rows = words.withColumn("longer", F.explode(F.array(size, size + 1))).withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(parts)])))
    low, high = (F.floor(F.col("longer") * (F.col("part") + i) / parts).cast("int") for i in (0, 1))
    rows = rows.withColumn("low", low).withColumn("high", high)
    before = F.left("word", F.col("low"))
    behind = F.right("word", F.col("longer") - F.col("high"))
    return rows.withColumn("key", F.concat_ws(" ", F.col("longer").cast("string"), F.col("part").cast("string"), before, behind))


def units(words: DataFrame, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """word, n, longer, low, high, unit, side: rows of one unit are compared, side 0 with 1, or side ITSELF among themselves."""
    keyed = _keyed(words, parts)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    met = keyed.join(sizes, "key")
    blocks = F.ceil(F.col("rows") / tile).cast("int")
    mine = F.pmod(F.xxhash64("word"), blocks).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("other", other)
    first, second = F.least("mine", "other"), F.greatest("mine", "other")
    unit = F.concat_ws(" ", "key", first.cast("string"), second.cast("string"))
    side = F.when(F.col("mine") == F.col("other"), ITSELF).otherwise((F.col("mine") > F.col("other")).cast("int"))
    return met.select("word", "n", "longer", "low", "high", unit.alias("unit"), side.alias("side"))


class Matrix:
    """Code points of words, padded behind (`ahead`) and before (`back`)."""

    def __init__(self, words: list[str], width: int):
        self.size = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        inside = np.arange(width) < self.size[:, None]
        self.ahead = np.zeros((len(words), width), dtype=np.uint32)
        self.ahead[inside] = points
        self.back = np.zeros_like(self.ahead)
        self.back[inside[:, ::-1]] = points

    def prefix(self, a, b) -> np.ndarray:
        """Length of the common prefix of rows `a` and `b`; padding never counts, as one word ends before it."""
        same = self.ahead[a] == self.ahead[b]
        return np.minimum(_run(same), np.minimum(self.size[a], self.size[b]))

    def suffix(self, a, b) -> np.ndarray:
        same = self.back[a] == self.back[b]
        return np.minimum(_run(same[..., ::-1]), np.minimum(self.size[a], self.size[b]))


def _run(same: np.ndarray) -> np.ndarray:
    """Trues at the start of the last axis."""
    return np.where(same.all(axis=-1), same.shape[-1], np.argmin(same, axis=-1)).astype(np.int32)


def near_pairs(words: list[str], unit: np.ndarray, side: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Row numbers (a, b) of near words of a unit that belong to its part. Rows are sorted by unit, then side."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = int(longer.max())
    matrix = Matrix(words, width)
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    ends = np.r_[starts[1:], len(unit)]
    own = side[starts] == ITSELF
    split = starts + np.add.reduceat((side != 1).astype(np.int64), starts)
    found_a, found_b = [], []
    # blocks of rows: all of a unit against all of its other side, or of itself; units of one shape are stacked
    left, right = split - starts, np.where(own, ends - starts, ends - split)
    first_right = np.where(own, starts, split)
    pad = lambda n: 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(int)
    shapes = np.stack([pad(left), pad(right)], axis=1)
    for rows, columns in np.unique(shapes, axis=0).tolist():
        at = np.flatnonzero((shapes == (rows, columns)).all(axis=1))
        step = max(1, CELLS // (rows * columns * width))
        for i in range(0, len(at), step):
            these = at[i : i + step]
            for top in range(0, rows, max(1, CELLS // (columns * width))):
                a = np.arange(top, min(rows, top + max(1, CELLS // (columns * width))))
                b = np.arange(columns)
                ok = (a[:, None] < left[these, None, None]) & (b < right[these, None, None])
                ia = np.where(a < left[these, None], starts[these, None] + a, 0)[:, :, None]
                ib = np.where(b < right[these, None], first_right[these, None] + b, 0)[:, None, :]
                top_length = longer[starts[these]][:, None, None]
                ok &= np.maximum(matrix.size[ia], matrix.size[ib]) == top_length
                ok &= (ia < ib) | ~own[these][:, None, None]
                prefix = matrix.prefix(ia, ib)
                ok &= (prefix >= low[starts[these]][:, None, None]) & (prefix < high[starts[these]][:, None, None])
                u, x, y = np.nonzero(ok)
                if not len(u):
                    continue
                ga, gb = ia[u, x, 0], ib[u, 0, y]
                near = prefix[u, x, y] + matrix.suffix(ga, gb) >= longer[ga] - 1
                found_a.append(ga[near])
                found_b.append(gb[near])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def near_words(words: DataFrame, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """word, other, other_n: near words of words(word, n), both ways round. Words must be distinct."""

    def compare(table: pa.Table) -> pa.RecordBatch:
        held = table.column("word").to_pylist()
        unit = table.column("unit").combine_chunks().dictionary_encode().indices.to_numpy()
        a, b = near_pairs(held, unit, *(table.column(c).to_numpy() for c in ("side", "longer", "low", "high")))
        one, two = np.r_[a, b], np.r_[b, a]
        word = table.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [word.take(pa.array(one)), word.take(pa.array(two)), table.column("n").combine_chunks().take(pa.array(two))], names=["word", "other", "other_n"]
        )

    def run(batches):
        held: pa.Table | None = None  # rows of the last unit, which may go on
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            unit = held.column("unit").combine_chunks().dictionary_encode()
            last = int(np.searchsorted(unit.indices.to_numpy(), len(unit.dictionary) - 1))
            if last:
                yield compare(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield compare(held)

    small_batches(words.sparkSession)
    dealt = units(words, parts, tile).repartition("unit").sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(run, "word string, other string, other_n long")


# --- forms and roots ------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form), where no word is its own form's form again."""
    held = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = held.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = held.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        held = step.drop("moved")
        if not step.where("moved").head(1):
            return held


def variants(words: DataFrame, least: int = LEAST_COUNT, times: int = TIMES, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """Per word of words(word, n) with n of `least` or more: word, n, n_near, form, form_n, root."""
    held = materialize(words.where(F.col("n") >= least), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_words(held, parts, tile).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = held.join(near, "word", "left")
    takes = -F.col("best.minus") >= times * F.col("n")
    judged = judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n"),
    )
    judged = materialize(judged, "forms")
    found = roots(judged.where("form IS NOT NULL"))
    return judged.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))


def groups(found: DataFrame) -> DataFrame:
    """Per root of variants(): root, n of all its spellings, and how many there are."""
    return found.groupBy("root").agg(F.sum("n").alias("n"), F.count("*").alias("n_spellings")).where("n_spellings > 1")
