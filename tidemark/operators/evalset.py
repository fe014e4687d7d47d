"""Prepare evaluation sets: how many pairs of which kind each file gets, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CATEGORIES

NAME_PATTERN = "^[a-z0-9-]+$"
NAME_LENGTH = 48
MOST_SAMPLES = 10


def _draw(total: Column, *of: Column) -> Column:
    """A number in [0, total) that is the same whenever the task is run again."""
    digest = F.substring(F.md5(F.concat_ws("|", *of)), 1, 8)
    return F.conv(digest, 16, 10).cast("long") % total


def category_slots(files: DataFrame, seed: int = 0) -> DataFrame:
    """files(dataset_id, file, n, mix map<string,int>) to one row per slot with its category.

    Slots are drawn with replacement at the mix's weights; without a positive weight all are
    `simple`.
    """
    through = [F.lit(0)]
    for name in CATEGORIES:
        weight = F.greatest(F.coalesce(F.col("mix")[name], F.lit(0)), F.lit(0))
        through.append(through[-1] + weight)
    bounds = [bound.alias(f"_to_{i}") for i, bound in enumerate(through[1:])]
    slots = files.select("dataset_id", "file", *bounds, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"))
    total = F.col(f"_to_{len(CATEGORIES) - 1}")
    drawn = slots.withColumn(
        "_at", _draw(F.greatest(total, F.lit(1)), F.col("file"), F.col("slot"), F.lit(seed))
    )
    category = F.when(total == 0, CATEGORIES[0])
    for i, name in enumerate(CATEGORIES):
        category = category.when(F.col("_at") < F.col(f"_to_{i}"), name)
    return drawn.select("dataset_id", "file", "slot", category.alias("category"))


def mix_violations(datasets: DataFrame) -> DataFrame:
    """Datasets whose settings are not allowed, with the reason."""
    total = F.aggregate(F.map_values("mix"), F.lit(0), lambda a, w: a + w)
    unknown = F.size(F.array_except(F.map_keys("mix"), F.array(*map(F.lit, CATEGORIES)))) > 0
    bad_name = ~F.col("name").rlike(NAME_PATTERN) | (F.length("name") > NAME_LENGTH)
    reason = (
        F.when(unknown, "unknown category")
        .when(total != 100, F.concat(F.lit("mix adds up to "), total))
        .when(~F.col("sample_per_file").between(1, MOST_SAMPLES), "samples per file")
        .when(bad_name, "name")
    )
    return datasets.select("dataset_id", reason.alias("reason")).where("reason IS NOT NULL")


def pair_slots(slots: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples matched to slots by position; what has no partner drops out.

    samples(dataset_id, file, slot, labels, allowed, ...): the slot decides the category, and
    labels not allowed are taken out.
    """
    joined = samples.join(slots, ["dataset_id", "file", "slot"])
    permitted = F.filter("labels", lambda label: F.array_contains(F.col("allowed"), label))
    return joined.withColumn("labels", permitted).drop("allowed")


def progress(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files, files with pairs, and pairs per dataset."""
    total = files.groupBy("dataset_id").agg(F.count("*").alias("file_count"))
    per_file = pairs.groupBy("dataset_id", "file").agg(F.count("*").alias("_n"))
    done = per_file.groupBy("dataset_id").agg(
        F.count("*").alias("parsed_count"), F.sum("_n").alias("pair_count")
    )
    return total.join(done, "dataset_id", "left").na.fill(0, ["parsed_count", "pair_count"])
