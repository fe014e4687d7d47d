"""Counters, histograms, gauges and agent traces as rollups of event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip
from tidemark.plans.skew import Ordered

# Upper bounds of the histograms, in seconds.
SEARCH_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 20, 30)
STAGE_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 20)
REPLY_BOUNDS = (0.5, 1, 2.5, 5, 10, 20, 30, 45, 60, 90, 120)
TOOL_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30)
STAGES = ("hyde", "embed", "search", "hydrate", "rerank")


def counter_rollup(events: DataFrame, labels: Sequence[str], amount: Column | None = None) -> DataFrame:
    """Total per label set; every event counts 1 unless `amount` says otherwise."""
    return events.groupBy(*labels).agg(F.sum(F.lit(1) if amount is None else amount).alias("total"))


def histogram(events: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per upper bound, with sum and count, in one pass over the events.

    Each bound is one running counter of the same aggregate, so events are not multiplied.
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"_le_{i}") for i, b in enumerate(bounds)]
    rolled = events.groupBy(*labels).agg(*counts, F.count(value).alias("count"), F.sum(value).alias("sum"))
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_le_{i}").alias("bucket"))
        for i, b in enumerate(bounds)
    ] + [F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket"))]
    return rolled.select(*labels, "count", "sum", F.inline(F.array(*rows)))


def inflight(spans: DataFrame, labels: Sequence[str]) -> DataFrame:
    """spans(span_id, started_at, ended_at, labels): how many run at once after every change.

    An end at the same moment as a start comes first.
    """
    def change(column: str, step: int) -> DataFrame:
        return spans.where(F.col(column).isNotNull()).select(
            *labels, "span_id", F.col(column).alias("ts"), F.lit(step).alias("step")
        )

    changes = change("started_at", 1).unionByName(change("ended_at", -1))
    return Ordered(changes, labels, ["ts", "step", "span_id"]).total("step", "running").done()


def inflight_peak(spans: DataFrame, labels: Sequence[str]) -> DataFrame:
    return inflight(spans, labels).groupBy(*labels).agg(F.max("running").alias("peak"))


def token_usage(messages: DataFrame) -> DataFrame:
    """messages(agent, input_tokens, output_tokens) to totals per agent and kind."""
    sums = messages.groupBy("agent").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output"),
    )
    return sums.unpivot("agent", ["input", "output"], "kind", "tokens")


def tool_outcomes(results: DataFrame) -> DataFrame:
    """Calls, mean and 95th percentile of whole milliseconds per agent, tool and status.

    The percentile counts distinct millisecond values, which stay few however hot a tool is.
    """
    return results.groupBy("agent", "tool", "status").agg(
        F.count("*").alias("calls"),
        F.avg("elapsed_ms").alias("mean_ms"),
        F.percentile("elapsed_ms", F.lit(0.95)).alias("p95_ms"),
    )


def handoff_traffic(frames: DataFrame) -> DataFrame:
    """frames(run_id, ts, frame_id, agent): how often a run moved from one agent to another."""
    known = Ordered(frames, ["run_id"], ["ts", "frame_id"]).previous("agent", "from_agent").done()
    moved = known.where(F.col("from_agent") != F.col("agent"))
    return moved.groupBy("from_agent", F.col("agent").alias("to_agent")).agg(F.count("*").alias("handoffs"))


def step_limit_runs(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """Runs in which an agent made as many model calls as it may: limits(agent, max_step)."""
    made = calls.groupBy("run_id", "agent").agg(F.count("*").alias("steps"))
    return made.join(limits, "agent").where(F.col("steps") >= F.col("max_step"))


def stage_breakdown(timings: DataFrame, labels: Sequence[str], stages: Sequence[str] = STAGES) -> DataFrame:
    """Seconds per stage side by side; the stages are named, so nothing is looked up first."""
    parts = [F.sum(F.when(F.col("stage") == s, F.col("seconds")).otherwise(0.0)).alias(s) for s in stages]
    return timings.groupBy(*labels).agg(*parts)


def transfer_alone(calls: Column, is_transfer) -> Column:
    """Of two or more tool calls keep only the first transfer, if there is one."""
    transfers = F.filter(calls, is_transfer)
    return F.when((F.size(calls) >= 2) & (F.size(transfers) > 0), F.slice(transfers, 1, 1)).otherwise(calls)


def visible_transcript(frames: DataFrame) -> DataFrame:
    """The message frames a user sees, numbered in order within the run.

    One row per message; a run is never gathered into one value.
    """
    said = frames.where((F.col("type") == "message") & (F.length(strip(F.col("content"))) > 0))
    said = said.withColumn("_one", F.lit(1))
    return Ordered(said, ["run_id"], ["ts", "frame_id"]).total("_one", "place").done().drop("_one")
