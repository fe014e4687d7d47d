"""Benchmark decontamination by winnowing.

Texts become sequences of words. A window is `SPAN` consecutive words of a benchmark item; an item
of fewer words is one window. From every run of W consecutive K-word hashes the smallest are kept as
fingerprints, W + K - 1 = SPAN, so any shared window shares a fingerprint. Documents' fingerprints
are looked up among the benchmark's, and each hit is extended word by word to both sides; words of
extensions that reach a whole window are hit. Items shorter than SPAN have fingerprints of their own
class, with a W (and K) that fits their length.

The benchmark's different rows are dealt by hash into blocks of about `BLOCK_WORDS` words, a stated
set searched in blocks; a block is sent to the executors and the documents pass it in a narrow scan,
without any shuffle of texts. Of several blocks one is held at a time and its results are written. A benchmark of the usual size is one block.

Defined results: null, empty and wordless texts have no words and no hits; items without words have
no windows; an item without an id marks words but is not listed; equal ids count once. Equal rows
get equal results. Extra columns pass through `keep_clean` untouched. An empty table on either side
is fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import alnum_words, packed, small_batches, unpacked
from tidemark.llm.words import ALNUM, Splitter, grams, slices
from tidemark.plans.skew import materialize

SPAN = 13
GRAM = 5
BLOCK_WORDS = 2_000_000
MIN_SHARE = 20  # contaminated when MIN_SHARE * hit words >= words
RESULT = "n_words long, spans array<struct<start:long,end:long>>, n_hit long, items array<string>"


def _sliding(values: np.ndarray, width: int, smaller) -> np.ndarray:
    """`smaller` of each `width` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = smaller(out[:-step], out[step:])
        have += step
    return out


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of hashes that are smallest in some run of `width` (in all of them, if fewer)."""
    n = len(hashes)
    if n == 0 or width == 1:
        return np.arange(n)
    width = min(width, n)
    lowest = _sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    best = _sliding(np.concatenate([edge, lowest, edge]), width, np.maximum)  # of the runs over a place
    return np.flatnonzero(best == hashes)


class Benchmark:
    """Fingerprints of a block of items, by class of item length."""

    def __init__(self, texts: pa.Array):
        words = Splitter(ALNUM).words(texts)
        self.words, self.first = words.hashes, words.first
        sizes = np.diff(words.first)
        self.classes = []
        for size in sorted({min(int(s), SPAN) for s in sizes if s}):
            own = np.flatnonzero((sizes >= SPAN) if size == SPAN else (sizes == size))
            k = min(GRAM, size)
            hashes, item, place = [], [], []
            for i in own:
                cut = grams(self.words[self.first[i] : self.first[i + 1]], k)
                at = winnowed(cut, size - k + 1)
                hashes.append(cut[at])
                item.append(np.full(len(at), i))
                place.append(at)
            hashes, item, place = map(np.concatenate, (hashes, item, place))
            order = np.argsort(hashes, kind="stable")
            self.classes.append((size, k, hashes[order], item[order], place[order]))

    def search(self, words, hit: np.ndarray) -> set[tuple[int, int]]:
        """Marks hit words (+1 where a span begins, -1 where it ends); the (document, item) pairs found."""
        found: set[tuple[int, int]] = set()
        doc_start, doc_end = words.first[:-1][words.doc], words.first[1:][words.doc]
        for size, k, hashes, items, places in self.classes:
            cut = grams(words.hashes, k)
            inside = np.arange(len(cut)) + k <= doc_end[: len(cut)]
            cut = np.where(inside, cut, np.iinfo(np.uint64).max)
            p = winnowed(cut, size - k + 1)
            p = p[inside[p]]
            low = np.searchsorted(hashes, cut[p], side="left")
            n = np.searchsorted(hashes, cut[p], side="right") - low
            some = n > 0
            p, low, n = p[some], low[some], n[some]
            if not len(p):
                continue
            entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            p, item = np.repeat(p, n), items[entry]
            q, item_start, item_end = self.first[item] + places[entry], self.first[item], self.first[item + 1]
            exact = np.ones(len(p), dtype=bool)
            for j in range(k):  # equal hashes of runs, now word by word
                exact &= words.hashes[p + j] == self.words[q + j]
            reach = size - k
            left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for count, step, at in ((left, -1, 0), (right, 1, k - 1)):
                going = exact.copy()
                for j in range(1, reach + 1):
                    x, y = p + at + step * j, q + at + step * j
                    going &= (x >= doc_start[p]) & (x < doc_end[p]) & (y >= item_start) & (y < item_end)
                    going[going] = words.hashes[x[going]] == self.words[y[going]]
                    count += going
            whole = exact & (left + k + right >= size)
            np.add.at(hit, p[whole] - left[whole], 1)
            np.add.at(hit, p[whole] + k + right[whole], -1)
            pairs = np.unique(words.doc[p[whole]] * np.int64(len(self.first)) + item[whole])
            found.update(zip((pairs // len(self.first)).tolist(), (pairs % len(self.first)).tolist()))
        return found


def _search(batches, block: pa.Table, rows):
    """Adds the result of one block to batches with a column `text`; keeps the column `row`."""
    texts = block.column("text").combine_chunks()
    benchmark = Benchmark(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
    ids = block.column("item").to_pylist()
    splitter = Splitter(ALNUM)
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            words = splitter.words(part.column("text"))
            n = part.num_rows
            marks = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            items: list[list[str]] = [[] for _ in range(n)]
            for doc, item in sorted(benchmark.search(words, marks)):
                if ids[item] is not None:
                    items[doc].append(ids[item])
            hit = np.cumsum(marks)[:-1] > 0
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8)]))
            # a span never crosses documents, but two may touch at their border
            starts = np.flatnonzero((edge == 1) | (hit & np.isin(np.arange(len(hit)), words.first[:-1])))
            spans: list[list[dict]] = [[] for _ in range(n)]
            ends = np.flatnonzero(np.concatenate([edge[1:] == -1, [True]]) | np.isin(np.arange(1, len(hit) + 1), words.first[1:])) if len(hit) else []
            ends = ends[hit[ends]] if len(hit) else []
            for a, z in zip(starts.tolist(), np.asarray(ends).tolist()):
                doc = int(words.doc[a])
                spans[doc].append({"start": a - int(words.first[doc]), "end": z + 1 - int(words.first[doc])})
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in rows]
                + [
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(np.bincount(words.doc[hit], minlength=n), pa.int64()),
                    pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                ],
                names=[*rows, "n_words", "spans", "n_hit", "items"],
            )


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    """The benchmark's different rows, dealt into blocks; none is fetched yet."""
    held = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).distinct()
    total = held.agg(F.sum(F.size(alnum_words(F.col("text"))))).head()[0] or 0
    n = -(-total // BLOCK_WORDS) or 1
    if n > 1:
        held = materialize(held, "benchmark")
    return [held.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _over(docs: DataFrame, block: DataFrame, written: bool = False) -> DataFrame:
    """`docs` has any columns besides `text`, which is dropped. If `written`, the block is let go at once."""
    small_batches(docs.sparkSession)
    rows = [c for c in docs.columns if c != "text"]
    held = docs.sparkSession.sparkContext.broadcast(block.toArrow())
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + T._parse_datatype_string(RESULT).fields)
    found = docs.mapInArrow(lambda batches: _search(batches, held.value, rows), schema)
    if written:
        found = materialize(found, "contamination")
        held.destroy()
    return found


def _over_all(docs: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """One block at a time passes the driver and the executors when there are several."""
    first, *more = [_over(docs, b, written=len(blocks) > 1) for b in blocks]
    return _merged(first, more) if more else first


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per row: key, n_words, spans (hit words, from and up to), n_hit, items (their ids as strings, sorted), contaminated."""
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.col(f"`{text}`").alias("text"))
    return _over_all(slim, _blocks(benchmark, item, item_text)).drop("version").withColumnRenamed("id", key).withColumn("contaminated", is_contaminated())


def is_contaminated():
    return (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words"))


def _merged(first: DataFrame, more: list[DataFrame]) -> DataFrame:
    """Results of several blocks as one: spans and items are united for each id and version of text."""
    every = first
    for block in more:
        every = every.unionByName(block)
    every = every.where(F.size("spans") > 0).groupBy("id", "version").agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("all_items"),
    )
    # the union of spans: sorted, each adds what lies beyond the furthest end before it
    step = lambda a, s: F.struct(
        F.when(
            (F.size(a["done"]) > 0) & (s["start"] <= F.coalesce(F.element_at(a["done"], -1)["end"], F.lit(-1))),
            F.concat(
                F.slice(a["done"], F.lit(1), F.size(a["done"]) - 1),
                F.array(F.struct(F.element_at(a["done"], -1)["start"].alias("start"), F.greatest(F.element_at(a["done"], -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(a["done"], F.array(s))).alias("done")
    )
    nothing = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"))
    every = every.withColumn("all_spans", F.aggregate(F.array_sort("all_spans"), nothing, step)["done"])
    a, b = first.alias("a"), every.alias("b")
    on = F.col("a.id").eqNullSafe(F.col("b.id")) & F.col("a.version").eqNullSafe(F.col("b.version"))
    spans = F.coalesce("all_spans", F.col("a.spans"))
    return a.join(b, on, "left").select(
        "a.id", "a.version", "a.n_words", spans.alias("spans"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]).alias("n_hit"),
        F.coalesce("all_items", F.col("a.items")).alias("items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    blocks = _blocks(benchmark, item, item_text)
    if len(blocks) == 1:
        return unpacked(_over(packed(docs, text=F.col(f"`{text}`")), blocks[0]).where(~is_contaminated()))
    slim = packed(docs, id=F.monotonically_increasing_id(), version=F.xxhash64(F.col(f"`{text}`")), text=F.col(f"`{text}`"))
    slim = slim.withColumn("id", F.xxhash64("_row"))  # equal rows are judged alike
    hits = _over_all(slim.drop("_row"), blocks)
    bad = hits.where(is_contaminated()).select("id").distinct()
    return unpacked(slim.join(bad, "id", "left_anti"))
