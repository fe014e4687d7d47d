from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog, chat, telemetry
from tidemark.plans import skew

T0 = datetime(2024, 1, 1)
VOTES = "vote_id long, ts timestamp, session_id long, message_id long, value string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("down, up, stuck, messages, score", [
    (1, 0, False, 2, 25), (0, 1, True, 2, 28), (0, 2, False, 2, 0), (9, 0, True, 0, 100), (0, 0, True, 5, 40),
])
def test_attention_score(spark, down, up, stuck, messages, score):
    row = spark.range(1).select(chat.attention_score(F.lit(down), F.lit(up), F.lit(stuck), F.lit(messages)).alias("s"))
    assert row.head()["s"] == score


@pytest.mark.parametrize("values, net", [
    (["like"], (1, 0)), (["like", "dislike"], (0, 1)), (["like", "dislike", None], (0, 0)), (["like", "like"], (1, 0)),
])
def test_votes(spark, values, net):
    votes = spark.createDataFrame([(i, at(i * 900), 1, 1, v) for i, v in enumerate(values)], VOTES)
    got = chat.net_votes(votes).head()
    assert (got["upvotes"], got["downvotes"]) == net
    deltas = chat.vote_deltas(votes).agg(F.sum("up"), F.sum("down")).head()
    assert tuple(deltas) == net


def test_gross_counts_differ_from_net(spark):
    kinds = ["dislike", "visit", "like", "like", "answer", "answer"]
    rows = [(i, 1, at(i), k, i == 5) for i, k in enumerate(kinds)]
    events = spark.createDataFrame(rows, "event_id long, session_id long, ts timestamp, kind string, stuck boolean")
    got = chat.attention_flags(events).head()
    assert (got["upvote_count"], got["downvote_count"], got["agent_cannot_answer"]) == (2, 0, True)


def test_feed_and_history(spark):
    rows = [("a", "active", False, at(1), 10), ("b", "disconnected", False, at(2), 90), ("c", "active", False, at(0), 10), ("d", "active", True, at(3), 99)]
    scored = spark.createDataFrame(rows, "session_id string, status string, intercepted boolean, created_at timestamp, priority int")
    feed = chat.attention_feed(scored)
    assert [r["session_id"] for r in catalog.page_of(feed, chat.attention_order(), 1, 10).collect()] == ["c", "a"]
    assert catalog.total_of(feed).head()["total"] == 2
    assert [r["session_id"] for r in catalog.in_dates(scored, "created_at", at(2), at(2)).collect()] == ["b"]
    bands = [spark.range(1).select(chat.priority_band(F.lit(s)).alias("b")).head()["b"] for s in (67, 66, 34, 33)]
    assert bands == ["urgent", "moderate", "moderate", "low"]


def test_pages(spark):
    rows = spark.createDataFrame([(f"s{i}", at(i)) for i in range(1, 6)], "session_id string, created_at timestamp")
    newest = (F.desc("created_at"), F.asc("session_id"))
    page = lambda n: [r["session_id"] for r in catalog.page_of(rows, newest, n, 2).collect()]
    assert (page(1), page(3), page(4)) == (["s5", "s4"], ["s1"], [])


def test_liveness_is_strict(spark):
    rows = [("a", "active", None), ("b", "disconnected", at(70)), ("c", "disconnected", at(71)), ("d", "disconnected", None)]
    sessions = spark.createDataFrame(rows, "session_id string, status string, disconnected_at timestamp")
    live = sessions.where(chat.is_live(F.lit(at(100)))).collect()
    assert [r["session_id"] for r in live] == ["a", "c"]


def test_stale_sessions(spark):
    sessions = spark.createDataFrame([("a", "active", at(0), None), ("b", "active", at(0), None), ("c", "active", at(0), None)], "session_id string, status string, created_at timestamp, disconnected_at timestamp")
    messages = spark.createDataFrame([("b", at(69)), ("c", at(70))], "session_id string, created_at timestamp")
    got = {r["session_id"]: r["status"] for r in chat.reconcile_stale(sessions, messages, F.lit(at(100))).collect()}
    assert got == {"a": "disconnected", "b": "disconnected", "c": "active"}


def test_session_state(spark):
    steps = {
        1: [(0, "connect"), (5, "disconnect"), (9, "disconnect"), (20, "connect")],
        2: [(0, "connect"), (5, "disconnect"), (9, "disconnect")],
        3: [(0, "connect"), (5, "disconnect"), (35, "connect"), (36, "connect")],
    }
    rows = [(s * 10 + i, s, at(m), k) for s, events in steps.items() for i, (m, k) in enumerate(events)]
    events = spark.createDataFrame(rows, "event_id long, session_id long, ts timestamp, kind string")
    got = {r["session_id"]: (r["status"], r["disconnected_at"]) for r in chat.session_state(events).collect()}
    assert got == {1: ("active", None), 2: ("disconnected", at(5)), 3: ("disconnected", at(5))}


@pytest.fixture
def one_second(spark):
    """A key with nearly all rows, all of one second, a null key as long, and short ones."""
    rows = [(k, T0, i, (i * 37) % 11 if i % 5 else None) for k in ("hot", None) for i in range(4000)]
    rows += [(f"k{i % 7}", T0 + timedelta(seconds=i % 3), i, i % 4) for i in range(60)]
    return spark.createDataFrame(rows, "k string, ts timestamp, i long, v long").repartition(8)


def test_scans_carry_over_blocks(one_second, monkeypatch):
    def scans():
        ordered = skew.Ordered(one_second, ["k"], ["ts", "i"]).previous("v", "before").total("v", "sum").max_before("v", "most")
        return ordered, sorted(map(str, ordered.done().collect()))

    plain, expected = scans()
    assert not plain.cut and len(expected) == one_second.count()
    monkeypatch.setattr(skew, "BLOCK_ROWS", 100)
    cut, got = scans()
    assert cut.cut and got == expected
    monkeypatch.setattr(skew, "MOST_BLOCKS", 7)
    assert scans()[1] == expected


def test_a_key_of_one_second_is_cut_evenly(one_second, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK_ROWS", 200)
    rows = skew.Ordered(one_second, ["k"], ["ts", "i"]).rows
    for key in ("hot", None):
        sizes = sorted(r["count"] for r in rows.where(F.col("k").eqNullSafe(key)).groupBy("_block").count().collect())
        assert len(sizes) >= 12 and sizes[-1] <= 2.5 * sizes[len(sizes) // 2]
    assert rows.where("_block IS NULL").count() == 60



def test_histogram_is_cumulative(spark):
    events = spark.createDataFrame([("a", v) for v in (0.1, 0.5, 3.0, 999.0)], "stage string, value double")
    got = {r["le"]: r["bucket"] for r in telemetry.histogram(events, ["stage"], "value", (0.5, 5)).collect()}
    assert got == {0.5: 2, 5.0: 3, float("inf"): 4}


def test_inflight(spark):
    spans = spark.createDataFrame([(1, "s", at(0), at(10)), (2, "s", at(5), at(15)), (3, "s", at(10), None)], "span_id long, stage string, started_at timestamp, ended_at timestamp")
    assert telemetry.inflight_peak(spans, ["stage"]).head()["peak"] == 2
    last = telemetry.inflight(spans, ["stage"]).orderBy(F.desc("ts")).head()
    assert last["running"] == 1


def test_transfer_alone(spark):
    rows = [(["a", "transfer_x", "transfer_y"],), (["transfer_x"],), (["a", "b"],)]
    calls = spark.createDataFrame(rows, "calls array<string>")
    kept = telemetry.transfer_alone(F.col("calls"), lambda c: F.startswith(c, F.lit("transfer_")))
    assert [r["k"] for r in calls.select(kept.alias("k")).collect()] == [["transfer_x"], ["transfer_x"], ["a", "b"]]


def test_catalog_rules(spark):
    rows = [("d1", "kb", None, "Zed", "folder"), ("d2", "kb", None, "empty", "folder"), ("f1", "kb", "d1", "a.txt", "file"), ("f2", "kb", None, "A.txt", "file")]
    nodes = spark.createDataFrame(rows, "node_id string, kb_id string, parent_id string, name string, type string")
    assert [r["node_id"] for r in catalog.list_folder(nodes, "kb", None).collect()] == ["d2", "d1", "f2"]
    assert [r["node_id"] for r in catalog.deletable_folders(nodes).collect()] == ["d2"]
    twice = nodes.unionByName(nodes)
    assert {tuple(r) for r in catalog.duplicate_keys(twice, ["kb_id", "parent_id", "name"]).collect()} == {("kb", "d1", "a.txt", 2)}
    agents = spark.createDataFrame(
        [(1, "a", "does a", "auto", []), (2, "b", "does b", "manual", [(1, ""), (9, "gone"), (3, "own words")]), (3, "c", "does c", "none", [])],
        "agent_id long, name string, description string, mode string, targets array<struct<target_id:long,description:string>>",
    )
    edges = {(r["agent_id"], r["target_id"]): r["description"] for r in catalog.handoff_edges(agents).collect()}
    assert edges == {(1, None): None, (2, 1): "does a", (2, 3): "own words"}
    asked = spark.createDataFrame([(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 9)], "agent_id long, target_id long")
    allowed = {(r["agent_id"], r["target_id"]) for r in catalog.allowed_transfers(asked.withColumn("n", F.lit(1)), agents).collect()}
    assert allowed == {(1, 2), (1, 3), (2, 1), (2, 3)}
    kinds = spark.createDataFrame([("Text/HTML; x=1",), ("application/PDF",), (" image/webp ",), ("video/mp4",), (None,)], "mime_type string")
    assert [r["k"] for r in kinds.select(catalog.file_kind(F.col("mime_type")).alias("k")).collect()] == ["text", "pdf", "image", None, None]
