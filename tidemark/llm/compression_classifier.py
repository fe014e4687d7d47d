"""Quality by compression: which labelled side's dictionary makes a text smaller.

Two zstandard dictionaries are trained, on pieces of good and of bad labelled texts. A text is cut
into pieces of `PIECE` bytes, each compressed alone so that the dictionaries and not the text's own
repeats decide, and the sizes are summed over the whole text. The difference of the sums over their
total is turned into a probability by logistic calibration on labelled texts that the dictionaries
have not seen.

Bounded samples: about `SAMPLE_TEXTS` labelled texts of each side for the dictionaries, at most half
of those there are and at most `SAMPLE_BYTES` together, taken whole in the order of a hash of their
key, and about `CALIBRATION_TEXTS` others. Everything else reads every row.

Defined results: null and empty texts score the share of good labels; with labels of one kind only
every text scores that share smoothed, (good + 1) / (labels + 2). A very long text is scored whole,
piece by piece; as a sample it counts whole or, above an eighth of `SAMPLE_BYTES`, not. Labels without
a document do not count; a key with several labels counts with each; repeated rows are scored each,
and texts alike score alike. An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_TEXTS = 4000
SAMPLE_BYTES = 16 << 20  # of each side
CALIBRATION_TEXTS = 6000
PIECE = 512
DICTIONARY = 112_640
LEVEL = 3
FOLDS, HELD_OUT = 4, 2


def held_out(key: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Rows that learning must not see; a null key counts as an empty one."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _chance(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _dictionary(pieces: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces)
    except zstandard.ZstdError:  # too few pieces to train on: their bytes as they are
        return zstandard.ZstdCompressionDict(b"\n".join(pieces)[-DICTIONARY:] or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Difference:
    """(bad size - good size) / (bad size + good size) of whole texts."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.sides = []
        for raw in dictionaries:
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=LEVEL)
            self.sides.append(
                zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

    def of(self, text: bytes) -> float:
        bad = good = 0
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            bad += len(self.sides[0].compress(piece))
            good += len(self.sides[1].compress(piece))
        return (bad - good) / (bad + good) if bad + good else float("nan")


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, slightly held towards 0, by Newton's method."""
    design = np.stack([np.ones_like(x), x], axis=1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 1e-3])
        move = np.linalg.solve(curve, design.T @ (weight * (y - p)) - np.array([1e-6, 1e-3]) * at)
        at = at + np.clip(move, -20, 20)
        if np.abs(move).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def _differences(df: DataFrame, model, keep: list[str]) -> DataFrame:
    """Adds `difference` to `keep`; `df` has a column text."""

    def run(batches):
        difference = Difference(model.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            values = [difference.of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(values, pa.float64())], names=[*keep, "difference"])

    schema = T.StructType([f for f in df.schema.fields if f.name in keep]).add("difference", T.DoubleType())
    return df.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """Per row: key, held_out, difference, score (0 to 1), predicted (1 from `threshold` on)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    n = [counts.get(0, 0), counts.get(1, 0)]
    prior = (n[1] + 1) / (n[0] + n[1] + 2)
    intercept, slope, model = math.log(prior / (1 - prior)), 0.0, None
    if all(n):
        share = [min(0.5, SAMPLE_TEXTS / c) for c in n]
        mine = F.when(F.col("y") == 1, share[1]).otherwise(share[0])
        learn = known.where(_chance(F.col("id"), 1) < mine)  # its expected size is bounded, so it may be broadcast
        order = [_chance(F.col("id"), 1), F.col("id"), F.xxhash64("text")]
        sample = slim.join(F.broadcast(learn), "id").withColumn("size", F.octet_length("text")).where(f"size BETWEEN 1 AND {SAMPLE_BYTES // 8}")
        along = Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        sample = sample.withColumn("sum", F.sum("size").over(along)).where(F.col("sum") <= SAMPLE_BYTES)
        pieces: tuple[list[bytes], list[bytes]] = ([], [])
        for row in sample.orderBy("y", *order).select("y", "text").collect():  # bounded by SAMPLE_BYTES
            raw = row["text"].encode()
            pieces[row["y"]].extend(raw[i : i + PIECE] for i in range(0, len(raw), PIECE))
        if all(pieces):
            model = spark.sparkContext.broadcast(tuple(_dictionary(p).as_bytes() for p in pieces))
            rest = known.where((_chance(F.col("id"), 1) >= mine) & (_chance(F.col("id"), 2) < CALIBRATION_TEXTS / sum(n)))
            seen = _differences(slim.join(F.broadcast(rest), "id").select("y", "text"), model, ["y"]).where("NOT isnan(difference)").toPandas()
            weight = np.where(seen["y"] == 1, 1 / (1 - share[1]), 1 / (1 - share[0]))
            if seen["y"].nunique() == 2:
                order = np.lexsort((seen["difference"], seen["y"]))
                intercept, slope = calibrate(seen["difference"].to_numpy()[order], seen["y"].to_numpy(float)[order], weight[order])
    if model is None:
        scored = slim.select("id", F.lit(float("nan")).alias("difference"))
    else:
        scored = _differences(slim, model, ["id"])
    odds = F.lit(intercept) + F.lit(slope) * F.col("difference")
    value = F.when(F.isnan("difference"), F.lit(prior)).otherwise(1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0)))))
    return scored.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "difference", value.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
