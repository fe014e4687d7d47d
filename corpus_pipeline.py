"""A training corpus from raw documents, stage by stage.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and
columns named like the operators' own; all but the last return their input's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, minhash_dedup, mixing, quality_rules, token_files
from tidemark.llm.bindings import tokenizer
from tidemark.plans.skew import materialize


PERCENT = 80  # of all shingles that near copies share


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and very short texts go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest key; of repeated rows one, of null keys all."""
    return minhash_dedup.keep_one(docs, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages; without a benchmark all stay, null texts too."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources reach their target weights; a null source is one of its own."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; per document its place in them and a checksum read back."""
    index = token_files.write(docs, tokenizer(), token_files.new_folder(spark))
    return token_files.read(index).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token files", tokens),
]
ORACLE_SQL = None  # tested against brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


Q = {"pipeline": run}
O: dict[str, str] = {}  # noqa: E741
