"""Sessions, votes, telemetry and live events read from `events` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.bindings.tables import load
from tidemark.operators import catalog, chat, telemetry
from tidemark.streaming import events as live

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def register(run):
        Q[name] = run
        if oracle:
            O[name] = oracle
        return run

    return register


def us(column: str):
    return F.unix_micros(column)


# --- a conversation is a session; its n-th turn comes n minutes after its start -------------

START = "2024-01-01 00:00:00"
NOW = "2024-01-03 00:00:00"

_CHATS = """sessions AS (SELECT DISTINCT conv_id AS session_id,
  (['active', 'disconnected', 'active'])[conv_id % 3 + 1] AS status, conv_id % 7 = 0 AS intercepted,
  TIMESTAMP '2024-01-01' + to_minutes(conv_id * 31) AS created_at,
  CASE WHEN conv_id % 3 = 1 THEN TIMESTAMP '2024-01-01' + to_minutes(conv_id * 31 + 9) END AS disconnected_at FROM conversations),
messages AS (SELECT conv_id * 1000 + turn AS message_id, conv_id AS session_id, role AS sender, text AS content,
  TIMESTAMP '2024-01-01' + to_minutes(conv_id * 31 + turn) AS created_at FROM conversations)"""


def _at(minutes):
    return F.lit(START).cast("timestamp") + F.make_dt_interval(mins=minutes.cast("int"))


def sessions(spark, sf):
    conv = F.col("conv_id")
    return load(spark, sf, "conversations").select("conv_id").distinct().select(
        conv.alias("session_id"), F.when(conv % 3 == 1, "disconnected").otherwise("active").alias("status"),
        (conv % 7 == 0).alias("intercepted"), _at(conv * 31).alias("created_at"),
        F.when(conv % 3 == 1, _at(conv * 31 + 9)).alias("disconnected_at"),
    )


def messages(spark, sf):
    conv, turn = F.col("conv_id"), F.col("turn")
    return load(spark, sf, "conversations").select(
        (conv * 1000 + turn).alias("message_id"), conv.alias("session_id"), F.col("role").alias("sender"),
        F.col("text").alias("content"), _at(conv * 31 + turn).alias("created_at"),
    )


@query("latest_messages", f"""WITH {_CHATS} SELECT session_id, message_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) AS place
FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) <= 5)""")
def latest_messages(spark, sf):
    return chat.latest_messages(messages(spark, sf), 5).select("session_id", "message_id", F.col("place").cast("long"))


@query("session_last_message", f"WITH {_CHATS} SELECT session_id, count(*) AS message_count, max_by(content, message_id) AS trigger_message FROM messages GROUP BY session_id")
def session_last_message(spark, sf):
    return chat.message_stats(messages(spark, sf))


@query("conversation_stats", f"""WITH {_CHATS} SELECT session_id, count(*) AS messages, count(*) FILTER (sender = 'user') AS n_user,
  count(*) FILTER (sender = 'assistant') AS n_assistant, count(*) FILTER (sender = 'system') AS n_system, epoch_us(max(created_at)) AS last_us FROM messages GROUP BY session_id""")
def conversation_stats(spark, sf):
    made = chat.conversation_stats(messages(spark, sf), ("user", "assistant", "system"))
    return made.withColumn("last_us", us("last_at")).drop("last_at")


# events: click = like, error = dislike, signup = admin visit, view = answer, purchase = other
_FLAGS = """stream AS (SELECT event_id, user_id AS session_id, ts, CASE event_type WHEN 'click' THEN 'like' WHEN 'error' THEN 'dislike'
  WHEN 'signup' THEN 'visit' WHEN 'view' THEN 'answer' ELSE 'other' END AS kind, value > 60 AS stuck FROM events),
visits AS (SELECT session_id, max((ts, event_id)) AS visit FROM stream WHERE kind = 'visit' GROUP BY 1),
since AS (SELECT s.* FROM stream s LEFT JOIN visits v USING (session_id) WHERE v.visit IS NULL OR (s.ts, s.event_id) > v.visit),
flags AS (SELECT k.session_id, count(*) FILTER (s.kind = 'like') AS upvote_count, count(*) FILTER (s.kind = 'dislike') AS downvote_count,
  coalesce(max_by(s.stuck, (s.ts, s.event_id)) FILTER (s.kind = 'answer'), false) AS agent_cannot_answer
  FROM (SELECT DISTINCT session_id FROM stream) k LEFT JOIN since s USING (session_id) GROUP BY k.session_id)"""


def _stream(spark, sf):
    kind = F.col("event_type")
    named = (
        F.when(kind == "click", "like").when(kind == "error", "dislike").when(kind == "signup", "visit")
        .when(kind == "view", "answer").otherwise("other")
    )
    return load(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        named.alias("kind"), (F.col("value") > 60).alias("stuck"),
    )


@query("attention_flags", f"WITH {_FLAGS} SELECT * FROM flags")
def attention_flags(spark, sf):
    return chat.attention_flags(_stream(spark, sf))


_SCORED = f"""WITH {_CHATS}, {_FLAGS}, counts AS (SELECT session_id, count(*) AS n, max_by(content, message_id) AS trigger_message FROM messages GROUP BY 1),
scored AS (SELECT s.*, trigger_message, greatest(0, least(100, round_even(100 * (coalesce(downvote_count, 0) / (coalesce(n, 0) + 2))
   - 50 * (coalesce(upvote_count, 0) / (coalesce(n, 0) + 2)) + CASE WHEN agent_cannot_answer THEN 40 ELSE 0 END, 0)))::INTEGER AS priority
  FROM sessions s LEFT JOIN flags USING (session_id) LEFT JOIN counts USING (session_id))"""


def _scored(spark, sf):
    return chat.attention_priority(sessions(spark, sf), chat.attention_flags(_stream(spark, sf)), messages(spark, sf))


@query("attention_priority", f"{_SCORED} SELECT session_id, priority, trigger_message FROM scored")
def attention_priority(spark, sf):
    return _scored(spark, sf).select("session_id", "priority", "trigger_message")


@query("attention_feed", f"""{_SCORED} SELECT session_id, priority FROM scored WHERE status = 'active' AND NOT intercepted
ORDER BY priority DESC, created_at, session_id LIMIT 20 OFFSET 20""")
def attention_feed(spark, sf):
    feed = chat.attention_feed(_scored(spark, sf))
    return catalog.page_of(feed, chat.attention_order(), 2, 20).select("session_id", "priority")


@query("priority_bands", f"""{_SCORED} SELECT CASE WHEN priority >= 67 THEN 'urgent' WHEN priority >= 34 THEN 'moderate' ELSE 'low' END AS band, count(*) AS sessions FROM scored GROUP BY 1""")
def priority_bands(spark, sf):
    banded = _scored(spark, sf).withColumn("band", chat.priority_band(F.col("priority")))
    return banded.groupBy("band").agg(F.count("*").alias("sessions"))


@query("session_history", f"""WITH {_CHATS} SELECT session_id, status FROM sessions WHERE created_at BETWEEN TIMESTAMP '2024-01-01 05:10:00' AND TIMESTAMP '2024-01-02'
ORDER BY created_at DESC, session_id LIMIT 25""")
def session_history(spark, sf):
    rows = catalog.in_dates(sessions(spark, sf), "created_at", F.lit("2024-01-01 05:10:00").cast("timestamp"), F.lit("2024-01-02").cast("timestamp"))
    return catalog.page_of(rows, (F.desc("created_at"), F.asc("session_id")), 1, 25).select("session_id", "status")


@query("session_liveness", f"""WITH {_CHATS} SELECT session_id FROM sessions WHERE status = 'active' OR (status = 'disconnected' AND disconnected_at > TIMESTAMP '2024-01-03' - INTERVAL 30 MINUTE)""")
def session_liveness(spark, sf):
    return sessions(spark, sf).where(chat.is_live(F.lit(NOW).cast("timestamp"))).select("session_id")


@query("stale_sessions", f"""WITH {_CHATS}, x AS (SELECT s.*, s.status = 'active' AND coalesce(l.last, s.created_at) < TIMESTAMP '2024-01-02' - INTERVAL 30 MINUTE AS stale
  FROM sessions s LEFT JOIN (SELECT session_id, max(created_at) AS last FROM messages GROUP BY 1) l USING (session_id))
SELECT session_id, CASE WHEN stale THEN 'disconnected' ELSE status END AS status, epoch_us(CASE WHEN stale THEN TIMESTAMP '2024-01-02' ELSE disconnected_at END)::VARCHAR AS left_us FROM x""")
def stale_sessions(spark, sf):
    now = F.lit("2024-01-02").cast("timestamp")
    made = chat.reconcile_stale(sessions(spark, sf), messages(spark, sf), now)
    return made.select("session_id", "status", us("disconnected_at").cast("string").alias("left_us"))


# views and clicks connect, errors and purchases disconnect; two days is the idle limit here.
# The statement walks each session's events one by one.
@query("session_state", """WITH RECURSIVE steps AS (SELECT user_id AS session_id, ts, event_type IN ('view', 'click') AS joins,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'signup'),
walk AS (SELECT session_id, n, joins AS active, CASE WHEN joins THEN NULL ELSE ts END AS gone FROM steps WHERE n = 1
  UNION ALL SELECT s.session_id, s.n,
    CASE WHEN s.joins THEN w.active OR w.gone > s.ts - INTERVAL 2880 MINUTE ELSE false END,
    CASE WHEN s.joins THEN CASE WHEN w.active OR w.gone > s.ts - INTERVAL 2880 MINUTE THEN NULL ELSE w.gone END
      ELSE CASE WHEN w.active THEN s.ts ELSE w.gone END END
  FROM walk w JOIN steps s ON s.session_id = w.session_id AND s.n = w.n + 1)
SELECT session_id, CASE WHEN active THEN 'active' ELSE 'disconnected' END AS status, epoch_us(gone)::VARCHAR AS left_us
FROM walk QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1""")
def session_state(spark, sf):
    rows = load(spark, sf, "events").where("event_type <> 'signup'").select(
        "event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type").isin("view", "click"), "connect").otherwise("disconnect").alias("kind"),
    )
    return chat.session_state(rows, idle_minutes=2880).select(
        "session_id", "status", us("disconnected_at").cast("string").alias("left_us")
    )


@query("takeover_audit", """WITH x AS (SELECT user_id AS session_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'intercept' WHEN 'purchase' THEN 'release' END AS kind,
  'admin-' || json_extract_string(props, '$.k') AS admin_id FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT session_id, max_by(admin_id, (ts, event_id)) FILTER (kind = 'intercept') AS last_intercepted_by, epoch_us(max(ts) FILTER (kind = 'intercept')) AS at_us,
  max_by(kind, (ts, event_id)) = 'intercept' AS intercepted FROM x GROUP BY session_id""")
def takeover_audit(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "intercept").when(F.col("event_type") == "purchase", "release")
    rows = load(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        F.concat(F.lit("admin-"), F.get_json_object("props", "$.k")).alias("admin_id"),
    )
    made = chat.takeover_audit(rows)
    return made.select("session_id", "last_intercepted_by", us("last_intercepted_at").alias("at_us"), "intercepted")


_VOTES = """votes AS (SELECT event_id AS vote_id, ts, user_id AS session_id, (json_extract_string(props, '$.k')::INTEGER % 5) AS message_id,
  CASE event_type WHEN 'click' THEN 'like' WHEN 'error' THEN 'dislike' END AS value FROM events WHERE event_type IN ('click', 'error', 'view'))"""


def votes(spark, sf):
    value = F.when(F.col("event_type") == "click", "like").when(F.col("event_type") == "error", "dislike")
    return load(spark, sf, "events").where("event_type IN ('click', 'error', 'view')").select(
        F.col("event_id").alias("vote_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"),
        (F.get_json_object("props", "$.k").cast("int") % 5).alias("message_id"), value.alias("value"),
    )


@query("net_votes", f"""WITH {_VOTES} SELECT session_id, count(*) FILTER (value = 'like') AS upvotes, count(*) FILTER (value = 'dislike') AS downvotes FROM (
  SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY session_id, message_id ORDER BY ts DESC, vote_id DESC) = 1) GROUP BY 1""")
def net_votes(spark, sf):
    return chat.net_votes(votes(spark, sf))


@query("vote_deltas", f"""WITH {_VOTES}, x AS (SELECT *, lag(value) OVER (PARTITION BY session_id, message_id ORDER BY ts, vote_id) AS old FROM votes)
SELECT vote_id, session_id, message_id, (coalesce(value = 'like', false))::INTEGER - (coalesce(old = 'like', false))::INTEGER AS up,
  (coalesce(value = 'dislike', false))::INTEGER - (coalesce(old = 'dislike', false))::INTEGER AS down FROM x""")
def vote_deltas(spark, sf):
    return chat.vote_deltas(votes(spark, sf))


# --- telemetry ------------------------------------------------------------------------------

_FRAMES = """frames AS (SELECT event_id AS frame_id, user_id AS run_id, ts, 'agent-' || json_extract_string(props, '$.k')::INTEGER % 4 AS agent,
  'tool-' || json_extract_string(props, '$.k')::INTEGER % 7 AS tool, CASE event_type WHEN 'view' THEN 'message' WHEN 'purchase' THEN 'tool_result' ELSE event_type END AS type,
  CASE WHEN value > 50 THEN 'error' ELSE 'success' END AS status, value, floor(value * 10)::INTEGER AS elapsed_ms,
  json_extract_string(props, '$.k')::INTEGER AS k, CASE WHEN value < 5 THEN '  ' ELSE 'said ' || event_id END AS content,
  (['hyde', 'embed', 'search', 'hydrate', 'rerank'])[json_extract_string(props, '$.k')::INTEGER % 5 + 1] AS stage FROM events)"""


def frames(spark, sf):
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    stage = F.element_at(F.array(*map(F.lit, telemetry.STAGES)), k % 5 + 1)
    return load(spark, sf, "events").select(
        F.col("event_id").alias("frame_id"), F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("agent-"), k % 4).alias("agent"), F.concat(F.lit("tool-"), k % 7).alias("tool"),
        F.when(kind == "view", "message").when(kind == "purchase", "tool_result").otherwise(kind).alias("type"),
        F.when(F.col("value") > 50, "error").otherwise("success").alias("status"), "value",
        F.floor(F.col("value") * 10).cast("int").alias("elapsed_ms"), k.alias("k"),
        F.when(F.col("value") < 5, "  ").otherwise(F.concat(F.lit("said "), "event_id")).alias("content"), stage.alias("stage"),
    )


@query("counter_rollup", f"WITH {_FRAMES} SELECT agent, status, count(*) AS total FROM frames GROUP BY ALL")
def counter_rollup(spark, sf):
    return telemetry.counter_rollup(frames(spark, sf), ["agent", "status"])


@query("histogram_buckets", f"""WITH {_FRAMES}, sums AS (SELECT stage, count(*) AS count, sum(value) AS sum FROM frames GROUP BY stage),
bounds AS (SELECT unnest([0.5, 1, 2.5, 5, 10, 20, 30, 45, 60, 90, 120, 'inf'::DOUBLE]::DOUBLE[]) AS le)
SELECT f.stage, le, count(*) FILTER (value <= le) AS bucket, s.count, round(s.sum, 4) AS sum FROM frames f CROSS JOIN bounds JOIN sums s USING (stage) GROUP BY f.stage, le, s.count, s.sum""")
def histogram_buckets(spark, sf):
    rolled = telemetry.histogram(frames(spark, sf), ["stage"], "value", telemetry.REPLY_BOUNDS)
    return rolled.withColumn("sum", F.round("sum", 4))


_GAUGE = f"""WITH {_FRAMES}, changes AS (SELECT stage, frame_id, ts, 1 AS step FROM frames
  UNION ALL SELECT stage, frame_id, ts + to_milliseconds(elapsed_ms * 60), -1 FROM frames),
running AS (SELECT stage, sum(step) OVER (PARTITION BY stage ORDER BY ts, step, frame_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running, ts, step, frame_id FROM changes)"""


def _spans(spark, sf):
    return frames(spark, sf).select(
        F.col("frame_id").alias("span_id"), "stage", F.col("ts").alias("started_at"),
        F.timestamp_micros(us("ts") + F.col("elapsed_ms").cast("long") * 60000).alias("ended_at"),
    )


@query("inflight_gauge", f"{_GAUGE} SELECT stage, frame_id AS span_id, step, epoch_us(ts) AS at_us, running FROM running")
def inflight_gauge(spark, sf):
    made = telemetry.inflight(_spans(spark, sf), ["stage"])
    return made.select("stage", "span_id", "step", us("ts").alias("at_us"), "running")


@query("inflight_peak", f"{_GAUGE} SELECT stage, max(running) AS peak FROM running GROUP BY stage")
def inflight_peak(spark, sf):
    return telemetry.inflight_peak(_spans(spark, sf), ["stage"])


@query("token_usage", f"""WITH {_FRAMES}, x AS (SELECT agent, sum(k)::BIGINT AS input, sum(elapsed_ms)::BIGINT AS output FROM frames WHERE type = 'message' GROUP BY agent)
SELECT agent, 'input' AS kind, input AS tokens FROM x UNION ALL SELECT agent, 'output', output FROM x""")
def token_usage(spark, sf):
    used = frames(spark, sf).where("type = 'message'").select(
        "agent", F.col("k").alias("input_tokens"), F.col("elapsed_ms").alias("output_tokens")
    )
    return telemetry.token_usage(used)


@query("tool_outcomes", f"""WITH {_FRAMES} SELECT agent, tool, status, count(*) AS calls, round(avg(elapsed_ms), 6) AS mean_ms, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95_ms
FROM frames WHERE type = 'tool_result' GROUP BY agent, tool, status""")
def tool_outcomes(spark, sf):
    made = telemetry.tool_outcomes(frames(spark, sf).where("type = 'tool_result'"))
    return made.withColumns({c: F.round(c, 6) for c in ("mean_ms", "p95_ms")})


@query("handoff_traffic", f"""WITH {_FRAMES}, x AS (SELECT lag(agent) OVER (PARTITION BY run_id ORDER BY ts, frame_id) AS from_agent, agent AS to_agent FROM frames)
SELECT from_agent, to_agent, count(*) AS handoffs FROM x WHERE from_agent <> to_agent GROUP BY ALL""")
def handoff_traffic(spark, sf):
    return telemetry.handoff_traffic(frames(spark, sf))


@query("step_limit_runs", f"""WITH {_FRAMES}, limits AS (SELECT agent, min(k) + 3 AS max_step FROM frames GROUP BY agent)
SELECT run_id, agent, count(*) AS steps, max_step FROM frames JOIN limits USING (agent) WHERE type = 'message' GROUP BY run_id, agent, max_step HAVING count(*) >= max_step""")
def step_limit_runs(spark, sf):
    rows = frames(spark, sf)
    limits = rows.groupBy("agent").agg((F.min("k") + 3).alias("max_step"))
    return telemetry.step_limit_runs(rows.where("type = 'message'"), limits).select("run_id", "agent", "steps", "max_step")


@query("stage_breakdown", f"""WITH {_FRAMES} SELECT agent, """ + ", ".join(f"round(sum(CASE WHEN stage = '{s}' THEN value ELSE 0 END), 4) AS {s}" for s in telemetry.STAGES) + " FROM frames GROUP BY agent")
def stage_breakdown(spark, sf):
    made = telemetry.stage_breakdown(frames(spark, sf).withColumnRenamed("value", "seconds"), ["agent"])
    return made.withColumns({s: F.round(s, 4) for s in telemetry.STAGES})


@query("transfer_alone", """WITH calls AS (SELECT o_orderkey, list((CASE WHEN l_returnflag = 'R' THEN 'transfer_to_' ELSE 'tool_' END) || l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS c
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, array_to_string(CASE WHEN len(c) >= 2 AND len(list_filter(c, lambda x: starts_with(x, 'transfer_to_'))) > 0
  THEN list_filter(c, lambda x: starts_with(x, 'transfer_to_'))[1:1] ELSE c END, ',') AS calls FROM calls""")
def transfer_alone(spark, sf):
    """An order is a message, its few lines the tool calls on it."""
    name = F.concat(F.when(F.col("l_returnflag") == "R", "transfer_to_").otherwise("tool_"), "l_suppkey")
    call = F.struct("l_linenumber", "l_suppkey", "l_partkey", name.alias("name"))
    calls = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(call)).alias("c")
    ).join(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    kept = telemetry.transfer_alone(F.transform("c", lambda x: x["name"]), lambda n: F.startswith(n, F.lit("transfer_to_")))
    return calls.select("o_orderkey", F.array_join(kept, ",").alias("calls"))


@query("visible_transcript", f"""WITH {_FRAMES} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, frame_id) AS place, agent, content
FROM frames WHERE type = 'message' AND trim(content) <> ''""")
def visible_transcript(spark, sf):
    return telemetry.visible_transcript(frames(spark, sf)).select("run_id", "place", "agent", "content")


# --- live events, as batch ------------------------------------------------------------------

# every event of more than 50 arrives cut off in the middle
_LINES = """lines AS (SELECT event_id, CASE WHEN value > 50 THEN '{"topic": "t", "event"' ELSE '{"topic": "' || user_id || '", "event": {"type": "' ||
  CASE event_type WHEN 'view' THEN 'message.created' WHEN 'click' THEN 'feedback.updated' ELSE event_type END || '", "session_id": "' || user_id % 100 ||
  '", "data": {"id": "' || (user_id % 100) * 1000 + json_extract_string(props, '$.k')::INTEGER % 8 || '"}}}' END AS value FROM events),
parsed AS (SELECT event_id, NOT json_valid(value) AS malformed, CASE WHEN json_valid(value) THEN value END AS v FROM lines),
known AS (SELECT event_id, malformed, json_extract_string(v, '$.topic') AS topic, json_extract_string(v, '$.event.type') AS type,
  json_extract_string(v, '$.event.session_id') AS session_id, json_extract_string(v, '$.event.data.id') AS message_id FROM parsed)"""


def envelope_lines(spark, sf):
    kind = F.col("event_type")
    named = F.when(kind == "view", live.MESSAGE_CREATED).when(kind == "click", live.FEEDBACK_UPDATED).otherwise(kind)
    session = F.col("user_id") % 100
    message = session * 1000 + F.get_json_object("props", "$.k").cast("int") % 8
    whole = F.concat(
        F.lit('{"topic": "'), "user_id", F.lit('", "event": {"type": "'), named, F.lit('", "session_id": "'), session,
        F.lit('", "data": {"id": "'), message, F.lit('"}}}'),
    )
    text = F.when(F.col("value") > 50, '{"topic": "t", "event"').otherwise(whole)
    return load(spark, sf, "events").select("event_id", text.alias("value"))


@query("event_parse", f"WITH {_LINES} SELECT event_id, malformed, topic, type, session_id, message_id FROM known")
def event_parse(spark, sf):
    parsed = live.parse_envelopes(envelope_lines(spark, sf))
    good = lambda c: F.when(~F.col("malformed"), F.col(c)).alias(c)
    return parsed.select(
        "event_id", "malformed", good("topic"), good("type"), good("session_id"),
        F.get_json_object("data", "$.id").alias("message_id"),
    )


@query("event_hydrate", f"""WITH {_LINES} SELECT event_id, k.session_id, k.message_id, c.role AS sender, c.text AS content FROM known k
JOIN conversations c ON c.conv_id::VARCHAR = k.session_id AND (c.conv_id * 1000 + c.turn)::VARCHAR = k.message_id WHERE NOT malformed AND type = 'message.created'""")
def event_hydrate(spark, sf):
    static = messages(spark, sf).select(
        F.col("session_id").cast("string"), F.col("message_id").cast("string"), "sender", "content"
    )
    made = live.hydrate(live.parse_envelopes(envelope_lines(spark, sf)), static)
    return made.select("event_id", "session_id", "message_id", "sender", "content")


def _timed(spark, sf):
    return load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("session_windows", """WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 360 MINUTE THEN 1 ELSE 0 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM x)
SELECT user_id, n::BIGINT AS session_number, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 360 MINUTE) AS ends_us, count(*) AS events FROM y GROUP BY user_id, n""")
def session_windows(spark, sf):
    made = live.session_windows(_timed(spark, sf), "user_id", "ts", "event_id", 360)
    return made.select("user_id", "session_number", us("first_at").alias("first_us"), us("ends_at").alias("ends_us"), "events")


@query("tumbling_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS events FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    made = live.tumbling_counts(_timed(spark, sf), "ts", "1 hour", ("event_type",))
    return made.select(us("window_start").alias("start_us"), "event_type", "events")


@query("sliding_avg", """SELECT start_us, event_type, round(avg(value), 6) AS mean FROM (
  SELECT event_type, value, epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) - unnest([0, 1, 2, 3])::BIGINT * 900000000 AS start_us FROM events) GROUP BY ALL""")
def sliding_avg(spark, sf):
    made = live.sliding_average(_timed(spark, sf), "ts", "1 hour", "15 minutes", "value", ("event_type",))
    return made.select(us("window_start").alias("start_us"), "event_type", F.round("mean", 6).alias("mean"))
