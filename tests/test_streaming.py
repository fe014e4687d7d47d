import glob
import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.bindings import chat as given
from tidemark.operators import chat, chunking
from tidemark.plans.corpus import build_corpus
from tidemark.plans.retrieval import retrieve
from tidemark.sources import files
from tidemark.sources.store import Index
from tidemark.streaming import events as live
from tidemark.streaming import live as streams

T0 = datetime(2024, 1, 1)


def stream_of(spark, df, path, parts=4, order="ts"):
    """Write `df` as several files in time order and read them back one file per trigger."""
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(path)
    for place, name in enumerate(sorted(glob.glob(f"{path}/part-*"))):
        os.utime(name, (place * 60, place * 60))  # a file stream reads the oldest file first
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, name, tmp_path, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))


def test_votes_equal_batch(spark, sf, tmp_path):
    votes = given.votes(spark, sf).withColumn("message_id", F.col("message_id").cast("long"))
    got = drained(streams.vote_deltas(stream_of(spark, votes, str(tmp_path / "in")), "3650 days"), "votes", tmp_path)
    assert same(got, chat.vote_deltas(votes))


def test_old_votes_are_forgotten(spark, tmp_path):
    """A message without votes for longer than `keep` starts anew, and its state is gone."""
    moments = [(1, "a", 0), (2, "b", 50), (3, "c", 51), (4, "c", 52), (5, "a", 53)]
    votes = spark.createDataFrame(
        [(i, "s", m, "like", T0 + timedelta(days=d)) for i, m, d in moments],
        "vote_id int, session_id string, message_id string, value string, ts timestamp",
    )
    for keep, again in (("30 days", 1), ("3650 days", 0)):
        name = f"kept_{again}"
        stream = stream_of(spark, votes, str(tmp_path / name), parts=5)
        query = (
            streams.vote_deltas(stream, keep).writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        ups = {r.vote_id: r.up for r in spark.table(name).collect()}
        assert ups == {1: 1, 2: 1, 3: 1, 4: 0, 5: again}
        dropped = sum(o["numRowsRemoved"] for p in query.recentProgress for o in p["stateOperators"])
        assert dropped == again


def test_attention_equals_batch(spark, sf, tmp_path):
    events = given._stream(spark, sf).withColumn("kind", F.when(F.col("kind") == "other", "message").otherwise(F.col("kind")))
    changes = streams.attention(stream_of(spark, events, str(tmp_path / "in"), parts=1), "3650 days")
    got = drained(changes, "attention", tmp_path, "update")
    assert same(got.drop("message_count"), chat.attention_flags(events))
    counts = events.groupBy("session_id").agg(F.count_if(F.col("kind") == "message").alias("message_count"))
    assert same(got.select("session_id", "message_count"), counts)
    assert streams.scored(got).where("priority NOT BETWEEN 0 AND 100").count() == 0


def test_changed_sessions_are_announced(spark, sf, tmp_path):
    events = given._stream(spark, sf)
    changes = streams.attention(stream_of(spark, events, str(tmp_path / "in"), parts=2), "3650 days")
    told = []
    query = streams.announce_changes(changes, lambda df, _: told.extend(r[0] for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert set(told) == {r[0] for r in events.select("session_id").distinct().collect()}


def with_closing_event(spark, events):
    """A far later event moves the watermark past everything before it."""
    late = events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"),
        F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"),
    )
    return events.unionByName(late)


def test_idle_sessions_equal_batch(spark, sf, tmp_path):
    events = given._timed(spark, sf)
    stream = stream_of(spark, with_closing_event(spark, events), str(tmp_path / "in"))
    got = drained(streams.idle_sessions(stream, "user_id", "ts", "6 hours", "10 minutes"), "idle", tmp_path)
    batch = live.session_windows(events, "user_id", "ts", "event_id", 360)
    assert same(got, batch.select("user_id", "first_at", "ends_at", "events"))


def test_windows_equal_batch(spark, sf, tmp_path):
    events = given._timed(spark, sf)
    stream = stream_of(spark, with_closing_event(spark, events), str(tmp_path / "in"))
    got = drained(streams.windowed_counts(stream, "ts", "1 hour", "10 minutes", ("event_type",)), "windows", tmp_path)
    assert same(got, live.tumbling_counts(events, "ts", "1 hour", ("event_type",)))


def test_repeated_events_count_once(spark, tmp_path):
    rows = [(i % 5, T0 + timedelta(minutes=i % 5)) for i in range(15)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp")
    stream = stream_of(spark, events, str(tmp_path / "in"), parts=1)
    got = drained(streams.deduplicated(stream, "event_id", "ts", "1 hour"), "once", tmp_path)
    assert sorted(r["event_id"] for r in got.collect()) == [0, 1, 2, 3, 4]


def test_live_hydration_equals_batch(spark, sf, tmp_path):
    lines = given.envelope_lines(spark, sf)
    messages = given.messages(spark, sf).select(
        F.col("session_id").cast("string"), F.col("message_id").cast("string"), "sender", "content"
    )
    stream = stream_of(spark, lines, str(tmp_path / "in"), parts=2, order="event_id")
    got = drained(live.hydrate(live.parse_envelopes(stream), messages), "hydrated", tmp_path)
    assert same(got, live.hydrate(live.parse_envelopes(lines), messages))
    known = live.known_events(live.parse_envelopes(lines))
    assert {r[0] for r in known.select("type").distinct().collect()} == set(live.KNOWN)


def build(pages):
    return build_corpus(chunking.join_pages(pages))


def searched(spark, corpus, *texts):
    asked = spark.createDataFrame([(i, "kb", t) for i, t in enumerate(texts)], "query_id long, kb_id string, text string")
    hits = retrieve(asked, corpus).orderBy("query_id", "rank")
    return [(r["query_id"], r["rank"], r["source"], r["content"], round(r["score"], 9)) for r in hits.collect()]


def test_uploads_equal_a_rebuild(spark, tmp_path):
    """Files come, come again and come changed; the stored index answers as one built from what is there."""
    uploads, index = tmp_path / "up", Index(spark, str(tmp_path / "index"))
    uploads.mkdir()

    def run():
        pages = streams.uploaded_pages(spark, str(uploads), "kb", per_trigger=1)
        streams.index_uploads(pages, build, index, "uploads", str(tmp_path / "cp")).awaitTermination(240)
        return index.open()

    def rebuilt():
        return build(files.read_text_files(spark, str(uploads), "kb"))

    questions = ("coins and medals", "silver", "pelicans", "old coins")
    for n, (name, text) in enumerate([("a.txt", "coins and medals of old"), ("b.txt", "old coins " * 200), ("c.txt", "pelicans with silver coins")]):
        (uploads / name).write_text(text)
    first = run()
    assert searched(spark, first, *questions) == searched(spark, rebuilt(), *questions) and len(index.versions()) == 3
    assert searched(spark, run(), *questions) == searched(spark, rebuilt(), *questions) and len(index.versions()) == 3
    (uploads / "a.txt").write_text("silver medals only")
    os.utime(uploads / "a.txt", (time.time() + 5, time.time() + 5))
    (uploads / "d.txt").write_text("medals")
    # a file source looks at a path once, so the changed file comes with a stream of its own
    pages = files.read_text_files(spark, str(uploads / "a.txt"), "kb")
    index.put(build(pages), pages, ("edits", 0))
    assert searched(spark, run(), *questions) == searched(spark, rebuilt(), *questions)
    idf = lambda corpus: {(r["term"], r["df"], r["n_children"], round(r["idf"], 9)) for r in corpus.idf.collect()}
    assert idf(index.open()) == idf(rebuilt())


def test_a_repeated_batch_counts_once(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    pages = spark.createDataFrame([("kb", "f", "f.txt", 0, "coins coins")], "kb_id string, doc_id string, source string, page_index int, markdown string")
    for batch in (0, 0, 1, 0):
        index.put(build(pages), pages, ("w", batch))
    assert len(index.versions()) == 2
    corpus = index.open()
    assert [(r["df"], r["n_children"]) for r in corpus.idf.collect()] == [(1, 1)] and corpus.children.count() == 1
