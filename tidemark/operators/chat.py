"""Sessions, messages and votes: what needs attention, who is live, how votes stand.

sessions(session_id, status, intercepted, created_at, disconnected_at, ...), messages(
message_id, session_id, sender, content, created_at), votes(vote_id, ts, session_id,
message_id, value). `now` is always a parameter, so a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.skew import Ordered, top_k

# Weights of the attention score, its smoothing, bands, and the idle limit.
DOWN_WEIGHT = 100
UP_WEIGHT = 50
STUCK_WEIGHT = 40
SMOOTHING = 2
BANDS = ((67, "urgent"), (34, "moderate"), (0, "low"))
IDLE_MINUTES = 30
LATEST_MESSAGES = 20


def _minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


# --- messages -------------------------------------------------------------------------------


def latest_messages(messages: DataFrame, n: int = LATEST_MESSAGES) -> DataFrame:
    """The newest `n` messages per session, with `place` counting from the oldest of them."""
    newest = top_k(messages, ["session_id"], ["-created_at", "-message_id"], n, "_back")
    counted = newest.groupBy("session_id").agg(F.max("_back").alias("_n"))
    return (
        newest.join(counted, "session_id")
        .withColumn("place", F.col("_n") - F.col("_back") + 1)
        .drop("_back", "_n")
    )


def message_stats(messages: DataFrame) -> DataFrame:
    """Messages per session and the text of the newest one."""
    newest = F.max_by("content", F.struct("created_at", "message_id"))
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), newest.alias("trigger_message")
    )


def conversation_stats(messages: DataFrame, senders: tuple[str, ...]) -> DataFrame:
    """Messages per session and sender, and when the last one came."""
    counts = [F.count_if(F.col("sender") == s).alias(f"n_{s}") for s in senders]
    return messages.groupBy("session_id").agg(
        F.count("*").alias("messages"), *counts, F.max("created_at").alias("last_at")
    )


# --- attention ------------------------------------------------------------------------------


def attention_score(down: Column, up: Column, stuck: Column, message_count: Column) -> Column:
    n = message_count + SMOOTHING
    raw = DOWN_WEIGHT * (down / n) - UP_WEIGHT * (up / n) + F.when(stuck, STUCK_WEIGHT).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw).cast("int")))


def priority_band(score: Column) -> Column:
    band = None
    for floor, name in BANDS:
        band = F.when(score >= floor, name) if band is None else band.when(score >= floor, name)
    return band


def attention_flags(events: DataFrame) -> DataFrame:
    """Likes and dislikes since the last admin visit, and whether the agent was stuck since.

    events(event_id, session_id, ts, kind, stuck) with kind like, dislike, visit or answer.
    These are gross counts: taking a vote back does not lower them, repeating it raises them.
    """
    moment = F.struct("ts", "event_id")
    visits = events.where("kind = 'visit'").groupBy("session_id").agg(F.max(moment).alias("_visit"))
    since = events.join(visits, "session_id", "left").where(
        F.col("_visit").isNull() | (moment > F.col("_visit"))
    )
    stuck = F.max_by(F.when(F.col("kind") == "answer", F.col("stuck")), F.when(F.col("kind") == "answer", moment))
    flags = since.groupBy("session_id").agg(
        F.count_if(F.col("kind") == "like").alias("upvote_count"),
        F.count_if(F.col("kind") == "dislike").alias("downvote_count"),
        F.coalesce(stuck, F.lit(False)).alias("agent_cannot_answer"),
    )
    known = events.select("session_id").distinct()
    return known.join(flags, "session_id", "left").select(
        "session_id",
        F.coalesce("upvote_count", F.lit(0)).alias("upvote_count"),
        F.coalesce("downvote_count", F.lit(0)).alias("downvote_count"),
        F.coalesce("agent_cannot_answer", F.lit(False)).alias("agent_cannot_answer"),
    )


def attention_priority(sessions: DataFrame, flags: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their score and the message that set it off."""
    scored = sessions.join(flags, "session_id", "left").join(message_stats(messages), "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.withColumn(
        "priority",
        attention_score(
            zero("downvote_count"), zero("upvote_count"),
            F.coalesce("agent_cannot_answer", F.lit(False)), zero("message_count"),
        ),
    )


def attention_feed(scored: DataFrame) -> DataFrame:
    """Active sessions nobody has taken over. Sort by attention_order, page with page_of."""
    return scored.where("status = 'active' AND NOT intercepted")


def attention_order() -> tuple[Column, ...]:
    return F.desc("priority"), F.asc("created_at"), F.asc("session_id")


# --- liveness -------------------------------------------------------------------------------


def is_live(now: Column, idle_minutes: int = IDLE_MINUTES) -> Column:
    """Active, or gone for less than the idle limit."""
    recent = F.col("disconnected_at") > now - _minutes(idle_minutes)
    return (F.col("status") == "active") | (
        (F.col("status") == "disconnected") & F.coalesce(recent, F.lit(False))
    )


def reconcile_stale(sessions: DataFrame, messages: DataFrame, now: Column, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """Active sessions silent for longer than the limit become disconnected as of `now`."""
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("_last"))
    silent = F.coalesce("_last", "created_at") < now - _minutes(idle_minutes)
    stale = (F.col("status") == "active") & silent
    return (
        sessions.join(last, "session_id", "left")
        .withColumn("_stale", stale)
        .withColumn("status", F.when(F.col("_stale"), "disconnected").otherwise(F.col("status")))
        .withColumn("disconnected_at", F.when(F.col("_stale"), now).otherwise(F.col("disconnected_at")))
        .drop("_last", "_stale")
    )


def session_state(events: DataFrame, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """Where each session ended up after events(event_id, session_id, ts, kind).

    kind is connect or disconnect. Disconnecting twice keeps the first time. Connecting again
    works only within the idle limit; after one failed attempt the session stays disconnected,
    because its time of leaving only gets older.
    """
    order = ["ts", "event_id"]
    known = Ordered(events, ["session_id"], order).previous("kind", "_before")
    left = (F.col("kind") == "disconnect") & ~F.col("_before").eqNullSafe("disconnect")
    known = known.column("_left", F.when(left, F.col("ts"))).max_before("_left", "_gone_since").done()
    back = (F.col("kind") == "connect") & (F.col("_before") == "disconnect")
    failed = back & ~(F.col("_gone_since") > F.col("ts") - _minutes(idle_minutes))
    moment = F.struct(*order)
    ended = known.groupBy("session_id").agg(
        F.min_by("_gone_since", F.when(failed, moment)).alias("_dead_since"),
        F.max_by("kind", moment).alias("_last"),
        F.max("_left").alias("_left_at"),
    )
    gone = F.col("_dead_since").isNotNull() | (F.col("_last") == "disconnect")
    return ended.select(
        "session_id",
        F.when(gone, "disconnected").otherwise("active").alias("status"),
        F.when(gone, F.coalesce("_dead_since", "_left_at")).alias("disconnected_at"),
    )


def takeover_audit(events: DataFrame) -> DataFrame:
    """events(event_id, session_id, ts, kind, admin_id): who last took over, kept after release."""
    moment = F.struct("ts", "event_id")
    took = F.when(F.col("kind") == "intercept", moment)
    return events.where("kind IN ('intercept', 'release')").groupBy("session_id").agg(
        F.max_by("admin_id", took).alias("last_intercepted_by"),
        F.max(F.when(F.col("kind") == "intercept", F.col("ts"))).alias("last_intercepted_at"),
        (F.max_by("kind", moment) == "intercept").alias("intercepted"),
    )


# --- votes ----------------------------------------------------------------------------------


def net_votes(votes: DataFrame) -> DataFrame:
    """Likes and dislikes per session, each message counted by its last vote."""
    last = votes.groupBy("session_id", "message_id").agg(
        F.max_by("value", F.struct("ts", "vote_id")).alias("value")
    )
    return last.groupBy("session_id").agg(
        F.count_if(F.col("value") == "like").alias("upvotes"),
        F.count_if(F.col("value") == "dislike").alias("downvotes"),
    )


def vote_deltas(votes: DataFrame) -> DataFrame:
    """What each vote changes: a switch moves one count to the other, a repeat changes nothing."""
    known = Ordered(votes, ["session_id", "message_id"], ["ts", "vote_id"]).previous("value", "_old").done()

    def change(value: str) -> Column:
        return F.col("value").eqNullSafe(value).cast("int") - F.col("_old").eqNullSafe(value).cast("int")

    return known.select(
        "vote_id", "session_id", "message_id", change("like").alias("up"), change("dislike").alias("down")
    )
