"""Live events: parsing, hydration, windows. The same functions serve batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.skew import Ordered

ENVELOPE = "topic string, event struct<type:string, session_id:string, data:string>"
# The kinds of events a reader knows.
MESSAGE_CREATED = "message.created"
FEEDBACK_UPDATED = "feedback.updated"
KNOWN = (MESSAGE_CREATED, FEEDBACK_UPDATED)


def parse_envelopes(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to topic, type, session_id, data; `malformed` marks what could not be read."""
    parsed = F.from_json(value, ENVELOPE, {"mode": "PERMISSIVE"})
    columns = lines.withColumn("_e", parsed)
    bad = F.col("_e.topic").isNull() | F.col("_e.event.type").isNull()
    return columns.select(
        *lines.columns,
        F.coalesce(bad, F.lit(True)).alias("malformed"),
        F.col("_e.topic").alias("topic"),
        F.col("_e.event.type").alias("type"),
        F.col("_e.event.session_id").alias("session_id"),
        F.col("_e.event.data").alias("data"),
    )


def known_events(parsed: DataFrame) -> DataFrame:
    """Well-formed events of a kind that is known; the rest is dropped."""
    return parsed.where(~F.col("malformed") & F.col("type").isin(*KNOWN))


def hydrate(parsed: DataFrame, messages: DataFrame) -> DataFrame:
    """`message.created` with its message; an event whose message is gone is dropped.

    The messages are the static side, so this works on a stream too.
    """
    made = parsed.where(~F.col("malformed") & (F.col("type") == MESSAGE_CREATED))
    keyed = made.withColumn("message_id", F.get_json_object("data", "$.id"))
    return keyed.join(messages, ["session_id", "message_id"])


def session_windows(events: DataFrame, key: str, ts: str, event_id: str, gap_minutes: int) -> DataFrame:
    """Batch twin of a session window: runs of events at most `gap_minutes` apart.

    Unlike a grouped session window it does not sort a long key in one task: neighbours and
    numbers are carried from block to block.
    """
    known = Ordered(events.select(key, ts, event_id), [key], [ts, event_id]).previous(ts, "_before")
    gap = F.make_dt_interval(mins=F.lit(gap_minutes))
    opens = F.col("_before").isNull() | (F.col(ts) >= F.col("_before") + gap)
    numbered = known.column("_opens", opens.cast("int")).total("_opens", "session_number").done()
    return numbered.groupBy(key, "session_number").agg(
        F.min(ts).alias("first_at"), (F.max(ts) + gap).alias("ends_at"), F.count("*").alias("events")
    )


def tumbling_counts(events: DataFrame, ts: str, width: str, labels: tuple[str, ...]) -> DataFrame:
    window = F.window(ts, width)
    return events.groupBy(window.alias("_w"), *labels).agg(F.count("*").alias("events")).select(
        F.col("_w.start").alias("window_start"), *labels, "events"
    )


def sliding_average(events: DataFrame, ts: str, width: str, step: str, value: str, labels: tuple[str, ...]) -> DataFrame:
    window = F.window(ts, width, step)
    return events.groupBy(window.alias("_w"), *labels).agg(F.avg(value).alias("mean")).select(
        F.col("_w.start").alias("window_start"), *labels, "mean"
    )
