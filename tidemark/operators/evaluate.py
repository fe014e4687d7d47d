"""Score retrieval against gold passages, and compare runs.

pairs(query_id, source_file, context, category, labels), hits(query_id, rank, parent_id,
source, content, score), runs(run_id, dataset_id, created_at, status, scores).
A query has at most top_k hits, so everything kept per query is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CATEGORIES, METRICS
from tidemark.functions.text import kept_positions, let, normalize_for_match, split_sentences
from tidemark.plans.skew import Ordered

UNTAGGED = "untagged"
FOUND = "array<struct<gold:int,start:int,end:int>>"


# --- pairs and hits -------------------------------------------------------------------------


def gold_sentences(context: Column) -> Column:
    return F.transform(split_sentences(context), normalize_for_match)


def _found(gold: Column, content: Column) -> Column:
    """Which gold sentences `content` holds, and where in its raw text."""

    def located(normalized: Column) -> Column:
        places = F.transform(
            gold,
            lambda g, i: F.struct(
                i.alias("gold"), F.instr(normalized, g).alias("at"), F.length(g).alias("n")
            ),
        )
        return F.filter(places, lambda p: p["at"] > 0)

    def mapped(matches: Column) -> Column:
        return let(
            kept_positions(content),
            lambda raw: F.transform(
                matches,
                lambda m: F.struct(
                    m["gold"].cast("int").alias("gold"),
                    F.element_at(raw, m["at"]).cast("int").alias("start"),
                    (F.element_at(raw, m["at"] + m["n"] - 1) + 1).cast("int").alias("end"),
                ),
            ),
        )

    nothing = F.array().cast(FOUND)
    return let(
        let(normalize_for_match(content), located),
        lambda matches: F.when(F.size(matches) > 0, mapped(matches)).otherwise(nothing),
    )


def judge(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hits with `found`: the gold sentences each one holds. Only the pair's own source counts."""
    gold = pairs.select("query_id", "source_file", gold_sentences(F.col("context")).alias("_gold"))
    own = F.col("source") == F.col("source_file")
    found = F.when(own & F.col("content").isNotNull(), _found(F.col("_gold"), F.col("content")))
    return (
        hits.join(gold, "query_id")
        .withColumn("found", F.coalesce(found, F.array().cast(FOUND)))
        .drop("_gold", "source_file")
    )


def gold_matches(judged: DataFrame) -> DataFrame:
    """One row per hit and gold sentence it holds."""
    return judged.select("query_id", "rank", "parent_id", F.inline("found"))


def highlights(judged: DataFrame) -> DataFrame:
    """One row per hit with its spans, sorted by position."""
    spans = F.array_sort(
        F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    )
    return judged.withColumn("highlights", spans).drop("found")


def pair_scores(judged: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair the four metrics and its status; a pair without hits scores 0."""
    relevant = F.size("found") > 0
    held = F.flatten(F.collect_list(F.transform("found", lambda f: f["gold"])))
    per_query = judged.groupBy("query_id").agg(
        F.avg(relevant.cast("double")).alias("_precision"),
        F.min(F.when(relevant, F.col("rank"))).alias("_first"),
        F.size(F.array_distinct(held)).alias("_covered"),
    )
    wanted = pairs.withColumn("_gold", F.size(gold_sentences(F.col("context"))))
    covered = F.coalesce("_covered", F.lit(0))
    recall = F.when(F.col("_gold") > 0, covered / F.col("_gold")).otherwise(0.0)
    status = (
        F.when((F.col("_gold") > 0) & (covered == F.col("_gold")), "full")
        .when(covered > 0, "partial")
        .otherwise("miss")
    )
    return wanted.join(per_query, "query_id", "left").select(
        "query_id",
        "category",
        "labels",
        F.coalesce("_precision", F.lit(0.0)).alias("context_precision"),
        recall.alias("context_recall"),
        F.col("_first").isNotNull().cast("double").alias("hit_rate"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        status.alias("status"),
    )


def run_scores(scores: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of each chosen metric over all pairs, one row per metric; no pairs, no rows."""
    means = scores.agg(F.count("*").alias("pairs"), *(F.avg(m).alias(m) for m in metrics))
    return (
        means.where("pairs > 0")
        .unpivot(["pairs"], list(metrics), "metric", "score")
    )


def _summary(groups: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    means = groups.groupBy(key).agg(F.count("*").alias("pairs"), *(F.avg(m).alias(m) for m in metrics))
    total = sum((F.col(m) for m in metrics[1:]), F.col(metrics[0]))
    return means.withColumn("score", total / len(metrics))


def breakdown_by_category(scores: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    return _summary(scores, "category", metrics)


def label_or_untagged(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.array_distinct(labels)).otherwise(F.array(F.lit(UNTAGGED)))


def breakdown_by_label(scores: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """A pair counts under each of its labels; pairs without any are `untagged`."""
    tagged = scores.withColumn("label", F.explode(label_or_untagged(F.col("labels"))))
    return _summary(tagged, "label", metrics)


def filter_pairs(
    pairs: DataFrame, category: str | None = None, label: str | None = None, status: str | None = None
) -> DataFrame:
    """Pairs that meet every given condition; the label `untagged` means no labels at all."""
    if category is not None:
        pairs = pairs.where(F.col("category") == category)
    if label == UNTAGGED:
        pairs = pairs.where(F.size("labels") == 0)
    elif label is not None:
        pairs = pairs.where(F.array_contains("labels", label))
    if status is not None:
        pairs = pairs.where(F.col("status") == status)
    return pairs


def result_documents(judged: DataFrame, pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """One nested row per pair: what was asked, what was found in rank order, how it scored."""
    hit = F.struct(
        "rank",
        F.col("parent_id").alias("chunk_id"),
        "source",
        "score",
        F.coalesce("content", F.lit("")).alias("content"),
        "highlights",
    )
    found = highlights(judged).groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("retrieved"))
    metrics = F.struct(*METRICS).alias("scores")
    return (
        pairs.join(found, "query_id", "left")
        .join(scores.select("query_id", metrics, "status"), "query_id")
    )


# --- runs -----------------------------------------------------------------------------------


def score_board(runs: DataFrame) -> DataFrame:
    """Scores of successful runs in long form; sort by created_at for the board's order."""
    return runs.where("status = 'success'").select(
        "dataset_id", "run_id", "created_at", F.explode("scores").alias("metric", "score")
    )


def latest_scores(runs: DataFrame) -> DataFrame:
    """The last known score of each metric per dataset."""
    latest = F.max_by("score", F.struct("created_at", "run_id"))
    return (
        score_board(runs).where("score IS NOT NULL").groupBy("dataset_id", "metric").agg(latest.alias("score"))
    )


def best_prior_scores(runs: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """For every run and metric the best score of successful runs made strictly earlier.

    Runs made at the same moment are folded into one row first, so equal times never count as
    earlier.
    """
    moments = runs.select(
        "dataset_id",
        "created_at",
        F.when(F.col("status") == "success", F.col("scores")).alias("_scores"),
        F.explode(F.array(*map(F.lit, metrics))).alias("metric"),
    ).groupBy("dataset_id", "metric", "created_at").agg(
        F.max(F.col("_scores")[F.col("metric")]).alias("_score")
    )
    scanned = Ordered(moments, ["dataset_id", "metric"], ["created_at"]).max_before("_score", "best").done()
    best = scanned.where("best IS NOT NULL").select("dataset_id", "created_at", "metric", "best")
    return runs.select("run_id", "dataset_id", "created_at").join(best, ["dataset_id", "created_at"])


def score_delta(runs: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """This run against the best before it, for the metrics either has.

    A metric this run lacks counts 0; one never scored before is compared with itself.
    """
    own = runs.select("run_id", F.explode("scores").alias("metric", "_own")).where("_own IS NOT NULL")
    best = best_prior_scores(runs, metrics).select("run_id", "metric", "best")
    joined = own.join(best, ["run_id", "metric"], "full")
    score = F.coalesce("_own", F.lit(0.0))
    return joined.select(
        "run_id",
        "metric",
        score.alias("score"),
        F.coalesce("best", score).alias("best"),
        (score - F.coalesce("best", score)).alias("delta"),
    )


def run_numbers(runs: DataFrame) -> DataFrame:
    """Runs named `<dataset>#<n>` in the order they were made."""
    counted = runs.withColumn("_one", F.lit(1))
    numbered = Ordered(counted, ["dataset_id"], ["created_at", "run_id"]).total("_one", "run_number").done()
    name = F.concat("dataset_name", F.lit(" #"), "run_number")
    return numbered.withColumn("name", name).drop("_one")


def reset_runs(runs: DataFrame, again: DataFrame) -> DataFrame:
    """Runs to be made again: outcome cleared and status pending; the others stay."""
    marked = runs.join(again.select("run_id").distinct().withColumn("_again", F.lit(True)), "run_id", "left")
    chosen = F.coalesce("_again", F.lit(False))
    for column in ("scores", "error", "result_path"):
        if column in runs.columns:
            marked = marked.withColumn(column, F.when(~chosen, F.col(column)))
    return marked.withColumn("status", F.when(chosen, "pending").otherwise(F.col("status"))).drop("_again")


def dataset_composition(datasets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs per category and per declared label, zeros kept, and how many carry no label.

    datasets(dataset_id, labels), pairs(dataset_id, category, labels).
    """
    by_category = pairs.groupBy("dataset_id", F.col("category").alias("name")).agg(F.count("*").alias("n"))
    tags = pairs.withColumn("name", F.explode(label_or_untagged(F.col("labels"))))
    by_label = tags.groupBy("dataset_id", "name").agg(F.count("*").alias("n"))
    wanted = lambda names: datasets.select("dataset_id", F.explode(names).alias("name"))
    parts = []
    for kind, names, counts in (
        ("category", F.array(*map(F.lit, CATEGORIES)), by_category),
        ("label", F.array_distinct("labels"), by_label),
    ):
        counted = wanted(names).join(counts, ["dataset_id", "name"], "left")
        parts.append(counted.select("dataset_id", F.lit(kind).alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("pairs")))
    untagged = by_label.where(F.col("name") == UNTAGGED).select(
        "dataset_id", F.lit("label").alias("kind"), "name", F.col("n").alias("pairs")
    )
    return parts[0].unionByName(parts[1]).unionByName(untagged)
