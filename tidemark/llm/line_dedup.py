"""Repeated passages by content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over the last `WINDOW` line hashes ends a chunk where
it is 0 modulo `DIVISOR`; so boundaries depend on the lines near them alone, and a passage that
moves within or between documents is cut at the same places. A line of `LONG` words or more is a
chunk of its own. Chunks of several lines, or of such a long line, are counted by hash over the
whole corpus; every occurrence after the first, in order of key, is removed once its bytes have
been compared with the first's.

A passage seldom begins and ends where chunks do, so every two neighbouring lines that hold text are
counted and compared in the same way, and what repeats, chunks and pairs, is joined to runs. A
repeated passage of two lines or more is thus taken out whole, wherever it stands; a short line
alone stays, unless it is a chunk together with blank lines. Every line taken out has an earlier
copy, so the first copy of a line always stays.

Defined results: a null text has no lines and an empty one has one empty line; nothing is removed
from either. Rows of equal key and text are one document, which does not repeat itself as a whole
but may repeat a chunk of its own. Null keys come first. Extra columns pass through `clean`
untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import packed
from tidemark.llm.words import draws, mix, slices
from tidemark.plans.skew import materialize

WINDOW = 2
DIVISOR = 3
LONG = 50
SPANS = "array<struct<first:int,n:int>>"


def chunk_ends(lines: list[str]) -> np.ndarray:
    """Numbers of the lines after which a chunk ends, the last line included."""
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], dtype=np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes), dtype=np.uint64)
        for back, factor in enumerate(draws(WINDOW, 61) | np.uint64(1)):
            rolled[back:] += hashes[: len(hashes) - back] * factor
        ends = mix(rolled) % np.uint64(DIVISOR) == 0
    ends[: WINDOW - 1] = False
    long = np.fromiter((len(x.split()) >= LONG for x in lines), dtype=bool, count=len(lines))
    ends |= long
    ends[:-1] |= long[1:]
    ends[-1] = True
    return np.flatnonzero(ends)


def chunks_of(text: str):
    """(number, first line, lines, text) of the chunks that count when repeated."""
    lines = text.split("\n")
    start = 0
    for number, end in enumerate(chunk_ends(lines).tolist()):
        n = end + 1 - start
        chunk = "\n".join(lines[start : end + 1])
        if (n > 1 or len(chunk.split()) >= LONG) and chunk.strip():
            yield number, start, n, chunk
        start = end + 1


def pairs_of(text: str):
    """(number, first line, lines, text) of every two neighbouring lines, with the blank lines between them."""
    lines = text.split("\n")
    worded = [i for i, line in enumerate(lines) if line.strip()]
    for a, z in zip(worded, worded[1:]):
        yield a, a, z + 1 - a, "\n".join(lines[a : z + 1])


def _units(docs: DataFrame) -> DataFrame:
    """Rows id, version, pair, number, first, n, hash of chunks and pairs, from id, version, text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                at, kinds, rows, hashes = [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for kind, units in enumerate((chunks_of, pairs_of)):
                        for *row, unit in units(text or ""):
                            at.append(i)
                            kinds.append(kind == 1)
                            rows.append(row)
                            hashes.append(xxhash.xxh3_64_intdigest(unit))
                take = pa.array(at, pa.int64())
                columns = [part.column("id").take(take), part.column("version").take(take), pa.array(kinds, pa.bool_())]
                columns += [pa.array([r[j] for r in rows], pa.int32()) for j in range(3)]
                columns.append(pa.array(np.array(hashes, dtype=np.uint64).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType(docs.schema.fields[:2] + T._parse_datatype_string("pair boolean, number int, first int, n int, hash long").fields)
    return docs.mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    """The `wanted` units of each text, with their bytes as `unit`, from id, version, text, wanted."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                wanted = part.column("wanted")
                owner = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
                found = wanted.flatten()
                texts, units, last, lines = part.column("text"), [], -1, []
                for i, first, n in zip(owner.tolist(), found.field("first").to_pylist(), found.field("n").to_pylist()):
                    if i != last:
                        last, lines = i, (texts[i].as_py() or "").split("\n")
                    units.append("\n".join(lines[first : first + n]))
                take = pa.array(owner, pa.int64())
                columns = [part.column("id").take(take), part.column("version").take(take), *found.flatten(), pa.array(units, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    fields = docs.schema["wanted"].dataType.elementType.fields
    schema = T.StructType([*docs.schema.fields[:2], *fields, T.StructField("unit", T.StringType())])
    return docs.mapInArrow(run, schema)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The units to remove: id, version, pair (or chunk), number, first line, lines, and whose unit they repeat."""
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.col(f"`{text}`").alias("text"))
    place = F.struct("id", "version", "number")
    units = materialize(_units(slim), "units")
    counted = units.groupBy("pair", "hash").agg(F.min(place).alias("kept"), F.max(place).alias("last"))
    repeated = materialize(counted.where("kept <> last").drop("last"), "repeated_units")
    again = units.join(repeated, ["pair", "hash"]).select(
        "id", "version", F.struct("pair", "number", "first", "n", "hash", F.col("kept.id").alias("kept_id"), place.eqNullSafe(F.col("kept")).alias("is_kept")).alias("unit")
    )
    wanted = again.groupBy("id", "version").agg(F.collect_set("unit").alias("wanted"))
    wanted = wanted.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "wanted")
    texts = slim.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    found = materialize(_texts(texts.select("id", "version", "text", "wanted")), "unit_texts")
    firsts = found.where("is_kept").select("pair", "hash", "unit").distinct()
    # bytes are compared by joining on them; a unit that only shares its hash stays
    same = found.where("NOT is_kept").join(firsts, ["pair", "hash", "unit"], "left_semi")
    return same.select("id", "version", "pair", "number", "first", "n", "kept_id").distinct()


def _runs(gone: DataFrame) -> DataFrame:
    """Per id and version: runs, the lines of all its repeated units joined where they meet or overlap."""
    along = Window.partitionBy("id", "version").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    units = gone.select("id", "version", "first", (F.col("first") + F.col("n")).alias("end")).distinct()
    units = units.withColumn("apart", F.coalesce(F.col("first") > F.max("end").over(along), F.lit(True)).cast("int"))
    units = units.withColumn("run", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = units.groupBy("id", "version", "run").agg(F.min("first").alias("first"), (F.max("end") - F.min("first")).alias("n"))
    return joined.groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).cast(SPANS).alias("runs"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_lines, n_removed (lines), removed (first line and number of lines), kept_ids, n_repeated, runs.

    n_removed and removed are of whole chunks; n_repeated and runs are of whole passages, which is
    what `clean` takes out.
    """
    units = materialize(repeats(docs, key, text), "repeats")
    chunk = F.when(~F.col("pair"), F.struct("first", "n"))
    gone = units.groupBy("id", "version").agg(
        F.array_sort(F.collect_list(chunk)).cast(SPANS).alias("removed"), F.array_sort(F.collect_set("kept_id")).alias("kept_ids")
    )
    whole = _runs(units).select(F.col("id").alias("_run_id"), F.col("version").alias("_run_version"), "runs")
    gone = gone.join(whole, F.col("id").eqNullSafe(F.col("_run_id")) & (F.col("version") == F.col("_run_version"))).drop("_run_id", "_run_version")
    rows = docs.select(
        F.col(f"`{key}`").alias(key), F.xxhash64(F.col(f"`{text}`")).alias("_version"),
        F.coalesce(F.size(F.split(F.col(f"`{text}`"), "\n")), F.lit(0)).alias("_lines"),
    )
    joined = rows.join(gone, F.col(key).eqNullSafe(F.col("id")) & (F.col("_version") == F.col("version")), "left")
    none = F.array().cast(SPANS)
    removed, runs = F.coalesce("removed", none), F.coalesce("runs", none)
    lines = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return joined.select(
        key, F.when(F.col("_lines") > 0, F.col("_lines")).otherwise(0).cast("long").alias("n_lines"),
        lines(removed).alias("n_removed"),
        removed.alias("removed"), F.coalesce("kept_ids", F.array().cast(gone.schema["kept_ids"].dataType)).alias("kept_ids"),
        lines(runs).alias("n_repeated"), runs.alias("runs"),
    )


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated passages taken out of `text`; a text that loses all lines is empty."""
    gone = _runs(repeats(docs, key, text)).withColumnRenamed("runs", "removed")
    gone = gone.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "removed")
    whole = packed(docs, id=F.col(f"`{key}`"), version=F.xxhash64(F.col(f"`{text}`")))
    joined = whole.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    lines = F.split(F.col(f"_row.`{text}`"), "\n")
    left = F.filter(lines, lambda x, i: ~F.exists("removed", lambda s: (i >= s["first"]) & (i < s["first"] + s["n"])))
    text_left = F.when(F.col("removed").isNull(), F.col(f"_row.`{text}`")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[(text_left if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
