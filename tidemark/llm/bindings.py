"""Every operator of this package applied to the given tables, and the SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    best_fit_packing, compression_classifier, decontaminate, importance_resampling, license_scan, line_dedup, log_bilinear, minhash_dedup, mixing,
    oracles, quality_rules, spelling_groups, token_files, url_filter,
)

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {  # noqa: E741
    "op3_minhash_dedup": oracles.NEAR_DUPLICATES,
    "op4_decontaminate": oracles.CONTAMINATION,
}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_files.write(table(spark, sf_dir, "documents"), tokenizer(), token_files.new_folder(spark))
    return token_files.read(index).withColumnRenamed("id", "doc_id")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.spans(table(spark, sf_dir, "documents"))


@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("difference")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.copies(table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.report(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


@query
def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(table(spark, sf_dir, "documents"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = best_fit_packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_groups.word_counts(table(spark, sf_dir, "documents"), noise=199)
    return spelling_groups.variants(words).select("word", "form", "root", "n", "n_near", "form_n")
