"""Structured Streaming jobs: votes, attention, idle sessions, windows, uploads.

Event time is always a column of type timestamp. Sources may deliver an event twice after a
restart, so streams start with `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.chat import attention_score
from tidemark.plans.corpus import Corpus
from tidemark.plans.skew import materialize
from tidemark.sources.files import as_pages
from tidemark.sources.store import Index

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def deduplicated(events: DataFrame, event_id: str, ts: str, late_by: str) -> DataFrame:
    return events.withWatermark(ts, late_by).dropDuplicatesWithinWatermark([event_id])


# --- windows --------------------------------------------------------------------------------


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str, late_by: str) -> DataFrame:
    """Sessions that ended because nothing came for `gap`; emitted once the watermark passes."""
    window = F.session_window(ts, gap)
    return (
        events.withWatermark(ts, late_by)
        .groupBy(key, window.alias("_w"))
        .agg(F.count("*").alias("events"))
        .select(key, F.col("_w.start").alias("first_at"), F.col("_w.end").alias("ends_at"), "events")
    )


def windowed_counts(events: DataFrame, ts: str, width: str, late_by: str, labels: tuple[str, ...]) -> DataFrame:
    return (
        events.withWatermark(ts, late_by)
        .groupBy(F.window(ts, width).alias("_w"), *labels)
        .agg(F.count("*").alias("events"))
        .select(F.col("_w.start").alias("window_start"), *labels, "events")
    )


# --- keyed state ----------------------------------------------------------------------------


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def vote_deltas(votes: DataFrame, keep: str) -> DataFrame:
    """What each vote changes, from the last vote kept per message. As chat.vote_deltas.

    `keep` is a time such as `30 days`: `ts` has a watermark that far behind, and a message whose
    last vote it has passed is forgotten, so state does not grow for ever.
    """
    out = f"{_kinds(votes, 'vote_id', 'session_id', 'message_id')}, up int, down int"
    votes, timeout, expires = _kept_for(votes, keep)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get[0] if state.exists else None
        latest = 0
        for batch in batches:
            batch = batch.sort_values(["ts", "vote_id"])
            latest = max(latest, _millis(batch["ts"]))
            values = batch["value"].where(batch["value"].notna(), None)
            before = pd.Series([old, *values[:-1]], index=batch.index, dtype=object)
            old = values.iloc[-1]
            yield pd.DataFrame(
                {
                    "vote_id": batch["vote_id"], "session_id": key[0], "message_id": key[1],
                    "up": (values == "like").astype(int) - (before == "like").astype(int),
                    "down": (values == "dislike").astype(int) - (before == "dislike").astype(int),
                }
            )
        state.update((old,))
        expires(state, latest)

    return votes.groupBy("session_id", "message_id").applyInPandasWithState(step, out, "value string", "append", timeout)


def _millis(moments: pd.Series) -> int:
    return int(pd.Timestamp(moments.max()).timestamp() * 1000) if len(moments) else 0


def _kept_for(events: DataFrame, keep: str):
    """Events with a watermark, the kind of timeout, and what sets a key's end."""

    def expires(state: GroupState, latest: int) -> None:
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)  # the watermark lags by `keep`

    return events.withWatermark("ts", keep), GroupStateTimeout.EventTimeTimeout, expires


def attention(events: DataFrame, keep: str) -> DataFrame:
    """Keeps likes, dislikes, stuck and message count per session, and scores every change.

    events(event_id, session_id, ts, kind, stuck) as for chat.attention_flags, plus kind
    `message`. Events count in the order they arrive; a visit starts the counts anew. One row
    per session and trigger comes out, in update mode; score it with `scored`. `keep` as for
    `vote_deltas`: a session without events for so long is forgotten.
    """
    events, timeout, expires = _kept_for(events, keep)
    out = f"{_kinds(events, 'session_id')}, " + "upvote_count long, downvote_count long, agent_cannot_answer boolean, message_count long"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        up, down, stuck, count = state.get if state.exists else (0, 0, False, 0)
        latest = 0
        for batch in batches:
            batch = batch.sort_values(["ts", "event_id"])
            latest = max(latest, _millis(batch["ts"]))
            count += int((batch["kind"] == "message").sum())
            visits = (batch["kind"] == "visit").to_numpy().nonzero()[0]
            if len(visits):
                up, down, stuck = 0, 0, False
                batch = batch.iloc[visits[-1] + 1:]
            up += int((batch["kind"] == "like").sum())
            down += int((batch["kind"] == "dislike").sum())
            answers = batch.loc[batch["kind"] == "answer", "stuck"]
            stuck = bool(answers.iloc[-1]) if len(answers) else stuck
        state.update((up, down, stuck, count))
        expires(state, latest)
        yield pd.DataFrame(
            {
                "session_id": [key[0]], "upvote_count": [up], "downvote_count": [down],
                "agent_cannot_answer": [stuck], "message_count": [count],
            }
        )

    return events.groupBy("session_id").applyInPandasWithState(
        step, out, "up long, down long, stuck boolean, count long", "update", timeout
    )


def scored(changes: DataFrame) -> DataFrame:
    return changes.withColumn(
        "priority",
        attention_score(
            F.col("downvote_count"), F.col("upvote_count"), F.col("agent_cannot_answer"), F.col("message_count")
        ),
    )


def announce_changes(changes: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each trigger's changed sessions to `publish`, so readers know to fetch them again."""

    def send(batch: DataFrame, batch_id: int) -> None:
        publish(batch.select("session_id").distinct(), batch_id)

    return (
        changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(send).start()
    )


# --- uploads --------------------------------------------------------------------------------


def uploaded_pages(spark: SparkSession, path: str, kb_id: str, per_trigger: int = 1000) -> DataFrame:
    """New text files under `path` as pages."""
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", per_trigger).load(path)
    )
    return as_pages(files, kb_id)


def index_uploads(
    pages: DataFrame, build: Callable[[DataFrame], Corpus], index: Index, writer: str, checkpoint: str
) -> StreamingQuery:
    """Chunk and index each trigger's files into a stored index, in place of what it holds of them.

    `build` maps pages to index tables, for example join_pages and build_corpus. Term statistics
    change by the files of the trigger alone. A trigger that runs twice counts once, by `writer`
    and its batch number; `writer` must be the same whenever the stream is started again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        held = materialize(batch, "uploads")
        index.put(build(held), held.select("kb_id", "doc_id"), (writer, batch_id))

    return (
        pages.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(store).start()
    )
