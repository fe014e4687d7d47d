"""Best-fit packing of documents into token sequences of one length, in rounds over the whole table.

A document is its ids and an end id. Only one longer than a sequence is cut: into whole sequences
and a rest, which comes first. What is left to pack are pieces shorter than a sequence.

Pieces are range-sorted by length and numbered within their length by a running count over the
ranges. Sequences with room are ranked within their gap's size. A round then

1. takes the band of the longest pieces left: lengths above `BAND` of the longest, not across half a
   sequence, or all lengths once none is above a `FINE`-th of a sequence;
2. sweeps over the band's lengths and the gaps in ascending order. Every gap's successor below it is
   the longest piece left that fits; it takes as many of that length as fit. Gaps that want the same
   pieces are settled by rank: of the gaps of one size and the pieces of one length each side is
   taken in order, so a sweep is a list of runs (pieces from .. to, gaps from .. to), at most one for
   each length and gap size;
3. opens new sequences for what no gap can hold, first the least number and, if that leaves some of
   the band, as many as the rest fills alone, and sweeps over these as well;
4. hands the runs to all tasks: each looks its gaps up by room and rank, and writes down who takes
   which pieces, what room is left and the rank within that, since a run's gaps stay in order.

Rounds repeat until no piece is left. Bands shrink geometrically, and so does a gap with each take,
so there are a few dozen rounds whatever the number of rows. A round moves no rows: only counts per
length and per gap size and the runs pass through the driver, and gaps are passed over once. Texts
and ids take no part. Each round's gaps are written, so a lost executor costs one round at most. At
last pieces meet what was written down for their length and rank in one join.

Defined results: a null or empty text is the end id alone; a very long text is cut as above, its
full pieces have sequences of their own; pieces of one length are taken in order of key (nulls
last), then text, so equal rows are placed side by side and reruns agree on all but the number of
a sequence; an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

import math
import re
import sys
import types
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.mixing import numbered
from tidemark.llm.text import small_batches
from tidemark.llm.token_files import Loader
from tidemark.llm.words import slices
from tidemark.plans.skew import materialize

LENGTH = 2048
BAND = 0.8
FINE = 4
FAR = 1 << 44  # above any number of sequences
CACHED = 1_000_000
LONGEST_CACHED = 64
GROUP = 64

# Splits before white space that follows a visible character, where byte-level pre-tokenizers split too.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = re.compile(f"[{SPACES}]")
PART = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


# --- ids ------------------------------------------------------------------------------------


def part_encoder(load: Callable, dtype: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes texts part by part, for byte-level tokenizers that split before white space.

    A distinct part is encoded once while a worker process remembers it, which it does for CACHED
    parts at most, also between tasks. Unknown parts are encoded GROUP at a time as one text and
    told apart by the bytes their ids stand for. Texts that hold a special token's string are
    encoded whole.
    """
    held = sys.modules.setdefault("_tidemark_part_ids", types.ModuleType("_tidemark_part_ids")).__dict__
    name = f"{load.args}{dtype}"
    if name not in held:
        tokenizer = load()
        lengths = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in tokenizer.get_vocab().items():
            lengths[i] = len(token)  # a character of a token's name is one byte
        held[name] = tokenizer, lengths, {}
    tokenizer, lengths, known = held[name]
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    width = np.dtype(dtype).itemsize

    def encoded(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=dtype) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(parts: list[str]) -> dict[str, bytes]:
        """Parts that begin with white space and end otherwise may stand one after another, others not."""
        chained = [p for p in parts if WHITE.match(p) and not WHITE.match(p[-1])]
        single = [p for p in parts if not WHITE.match(p) or WHITE.match(p[-1])]
        out = {p: ids.tobytes() for p, ids in zip(single, encoded(single))}
        groups = [chained[i : i + GROUP] for i in range(0, len(chained), GROUP)]
        for group, ids in zip(groups, encoded(["".join(g) for g in groups])):
            sizes = np.fromiter((len(p.encode()) for p in group), dtype=np.int64, count=len(group))
            ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes)) + 1
            raw, cut = ids.tobytes(), (ends * width).tolist()
            out.update((p, raw[x:z]) for p, x, z in zip(group, [0, *cut], cut))
        return out

    def encode(texts: list[str]) -> list[bytes]:
        split = [PART.findall(t) for t in texts]
        whole = [i for i, t in enumerate(texts) if any(s in t for s in special)]
        for i in whole:
            split[i] = []
        flat = [p for parts in split for p in parts]
        ids = list(map(known.get, flat))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            new = learn(list({flat[i] for i in missing}))
            for i in missing:
                ids[i] = new[flat[i]]
            if len(known) + len(new) > CACHED:
                known.clear()
            known.update((p, x) for p, x in new.items() if len(p) <= LONGEST_CACHED)
        out, at = [], 0
        for parts in split:
            out.append(b"".join(ids[at : at + len(parts)]))
            at += len(parts)
        for i, x in zip(whole, encoded([texts[i] for i in whole])):
            out[i] = x.tobytes()
        return out

    return encode


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the rest first, then whole sequences."""
    first = n % length or length
    return [(0, first), *((at, length) for at in range(first, n, length))]


def pieces(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, length: int = LENGTH,
    dtype: str = "<u2", with_ids: bool = False,
) -> DataFrame:
    """One written row per piece: row (a number of its own), id, version, piece, start, length, ids_crc32, and `ids` on demand."""
    schema = T.StructType().add("id", docs.schema[key].dataType).add("version", T.LongType()).add("piece", T.IntegerType())
    schema = schema.add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())
    if with_ids:
        schema = schema.add("ids", T.BinaryType())

    def run(batches):
        encode = part_encoder(Loader(tokenizer), dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        width = np.dtype(dtype).itemsize
        for part in (p for b in batches for p in slices(b, "text", 1 << 20)):
            rows: list[tuple] = []
            for at, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                ids += end
                for piece, (start, n) in enumerate(cuts(len(ids) // width, length)):
                    held = ids[start * width : (start + n) * width]
                    wide = np.frombuffer(held, dtype=dtype).astype("<u4").tobytes()
                    rows.append((at, piece, start, n, zlib.crc32(wide), held))
            at, *columns, held = zip(*rows)
            take = pa.array(at, pa.int64())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [part.column("id").take(take), part.column("version").take(take), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            if with_ids:
                arrays.append(pa.array(held, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    small_batches(docs.sparkSession)
    held = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.col(f"`{text}`").alias("text"))
    return materialize(held.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "pieces")


# --- rounds ---------------------------------------------------------------------------------


def band_of(left: dict[int, int], length: int) -> dict[int, int]:
    """The pieces ({length: rows}) that a round looks at."""
    longest = max(left)
    if longest * FINE <= length:
        return left
    low = max(int(longest * BAND), length // 2 if 2 * longest > length else 0)
    return {size: n for size, n in left.items() if size > low}


def needed(band: dict[int, int], gaps: dict[int, int], length: int, again: bool) -> int:
    """New sequences for a band's pieces that no gap ({room: sequences}) can hold.

    At first as many as any packing needs by volume, so that long pieces may share with others of
    the band. What is left of a band of long pieces after that gets as many as it fills by itself.
    """
    largest = max(gaps, default=0)
    alone = {size: n for size, n in band.items() if size > largest}
    short = max(band) * FINE <= length
    if again and not short:
        return math.ceil(sum(Fraction(n, length // size) for size, n in alone.items()))
    least = math.ceil(Fraction(sum(n * size for size, n in alone.items()), length))
    if short:  # all that is left: gaps take their part of it
        volume, room = (sum(n * size for size, n in held.items()) for held in (band, gaps))
        return max(least, math.ceil(Fraction(volume - room, length)), 0)
    return least


def sweep(left: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (room, first gap, gaps, size, pieces): `gaps` gaps of one room share `pieces` pieces of one size.

    Each takes room // size of them but for the last, which takes what remains. Ascending; at equal
    size pieces come before gaps. A stack holds the pieces passed, the longest on top.
    """
    stack: list[list[int]] = []
    runs = []
    for at, is_gap in sorted([(s, False) for s in left] + [(g, True) for g in gaps]):
        if not is_gap:
            stack.append([at, left[at]])
            continue
        first, end = 0, gaps[at]
        while stack and first < end:
            size, n = stack[-1]
            each = at // size
            taken = min(n, (end - first) * each)
            used = -(-taken // each)
            runs.append((at, first, used, size, taken))
            first += used
            stack[-1][1] -= taken
            if stack[-1][1] == 0:
                stack.pop()
    return runs


def _plan(runs: list[tuple], gaps: dict[int, int], taken: dict[int, int], least: int) -> tuple[np.ndarray, dict[int, int], dict[int, int]]:
    """What a sweep does to the gaps of each room by their rank, the gaps after it, and the pieces taken.

    Rows of the table are (room, first rank, gaps, size, rank of the first piece, pieces, pieces of
    a gap, rank of the first gap among those of its new room, the same for the last gap, which may
    take fewer). Gaps smaller than `least` are closed.
    """
    table, after, ranks, covered = [], {}, dict(taken), {}

    def enter(room: int, n: int) -> int:
        at = after.get(room, 0)
        after[room] = at + n
        return at

    for room, first, used, size, n in runs:
        each = room // size
        full, rest = divmod(n, each)
        rank = ranks.get(size, 0)
        ranks[size] = rank + n
        table.append((room, first, used, size, rank, n, each, enter(room - each * size, full), enter(room - rest * size, 1) if rest else 0))
        covered[room] = first + used
    for room, n in gaps.items():
        first = covered.get(room, 0)
        if first < n:
            table.append((room, first, n - first, 0, 0, 0, 0, enter(room, n - first), 0))
    after = {room: n for room, n in after.items() if n and room >= least}
    return np.array(sorted(table), dtype=np.int64).T, after, ranks


def _apply(gaps: DataFrame, table: np.ndarray) -> DataFrame:
    """Gaps (sequence, room, rank) after a sweep: what they take, their room left and their rank in it. No row moves."""
    shipped = gaps.sparkSession.sparkContext.broadcast(table)  # a row per length and gap size at most

    def run(batches):
        rooms, firsts, used, sizes, ranks, n, each, into, last = shipped.value
        starts = rooms * FAR + firsts
        for batch in batches:
            room, rank = (batch.column(c).to_numpy() for c in ("room", "rank"))
            i = np.searchsorted(starts, room * FAR + rank, side="right") - 1
            nth = rank - firsts[i]
            count = np.minimum(each[i], n[i] - nth * each[i])
            partial = count < each[i]
            columns = (room, sizes[i], ranks[i] + nth * each[i], count, room - count * sizes[i], np.where(partial, last[i], into[i] + nth))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence"), *map(pa.array, columns)], names=["sequence", "room", "size", "first", "n", "left", "rank"]
            )

    return gaps.mapInArrow(run, "sequence long, room long, size long, first long, n long, left long, rank long")


def place(sized: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence and at to pieces(row, length, and an order within a length: id, version, piece)."""
    spark = sized.sparkSession
    small = sized.where(F.col("length") < length)
    counts = {r["length"]: r["n"] for r in small.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    before, starts = 0, []
    for size in sorted(counts):
        starts.append((size, before))
        before += counts[size]
    ranked = numbered(small, "length", "id", "version", "piece", "row")
    ranked = ranked.join(F.broadcast(spark.createDataFrame(starts, "length long, _before long")), "length")
    ranked = ranked.withColumn("rank", F.col("place") - F.col("_before")).drop("place", "_before")

    left, taken, opened, low, logs = dict(counts), {}, 0, length, []
    gaps, rooms = None, {}
    while left:
        again = max(left) > low
        band = {size: n for size, n in left.items() if size > low} if again else band_of(left, length)
        low = low if again else min(band) - 1
        new = needed(band, rooms, length, again)
        if new:
            fresh = spark.range(opened, opened + new).select(
                F.col("id").alias("sequence"), F.lit(length).cast("long").alias("room"), (F.col("id") - opened + rooms.get(length, 0)).alias("rank")
            )
            gaps = fresh if gaps is None else gaps.unionByName(fresh)
            rooms[length] = rooms.get(length, 0) + new
            opened += new
        runs = sweep(band, rooms)
        for _, _, _, size, n in runs:
            left[size] -= n
        left = {size: n for size, n in left.items() if n}
        least = min(left, default=length + 1)
        table, rooms, taken = _plan(runs, rooms, taken, least)
        log = materialize(_apply(gaps, table), "packing_round")
        logs.append(log.where("n > 0"))
        gaps = log.where(F.col("left") >= least).select("sequence", F.col("left").alias("room"), "rank")
    if logs:
        takes = logs[0]
        for log in logs[1:]:
            takes = takes.unionByName(log)
        # a row per piece taken: its rank among those of its length
        nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth")
        takes = takes.select("sequence", "room", "size", "first", nth)
        takes = takes.select(
            F.col("size").alias("length"), (F.col("first") + F.col("nth")).alias("rank"), "sequence",
            (length - F.col("room") + F.col("nth") * F.col("size")).alias("at"),
        )
        placed = ranked.join(takes, ["length", "rank"])
    else:
        placed = ranked.withColumn("sequence", F.lit(0).cast("long")).withColumn("at", F.lit(0).cast("long"))
    # whole sequences are numbered after the others by their rows, which are unique
    full = sized.where(F.col("length") >= length).withColumn("sequence", F.lit(opened) + F.col("row")).withColumn("at", F.lit(0).cast("long"))
    return placed.drop("rank").unionByName(full)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return placed(pieces(docs, tokenizer, key, text, end_id, length), length).drop("row", "version")


def placed(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces() with sequence_id and offset. Ids, if there, are joined again after the placing."""
    spots = place(cut.drop("ids"), length).withColumnRenamed("sequence", "sequence_id").withColumnRenamed("at", "offset")
    return spots.join(cut.select("row", "ids"), "row") if "ids" in cut.columns else spots


def sequences(cut: DataFrame, length: int = LENGTH, dtype: str = "<u2") -> DataFrame:
    """The sequences themselves, from pieces(with_ids=True): sequence_id, tokens (little-endian bytes), n_tokens, starts.

    `starts` are the offsets where a piece begins, for masks between documents. A sequence holds
    `length` ids at most, so no group is large.
    """
    width = np.dtype(dtype).itemsize
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    tokens = F.aggregate(F.col("_parts"), F.lit(b""), lambda held, part: F.concat(held, part["ids"]))
    grouped = placed(cut, length).groupBy("sequence_id").agg(parts.alias("_parts"))
    return grouped.select(
        "sequence_id", tokens.alias("tokens"), (F.octet_length(tokens) / width).cast("int").alias("n_tokens"),
        F.transform("_parts", lambda part: part["offset"]).alias("starts"),
    )
