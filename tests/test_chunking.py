import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import splitting
from tidemark.functions.splitting import TAG_BREAKS, TEXT_BREAKS, split_spans
from tidemark.operators import chunking


def paged(spark, *texts, indexes=None):
    rows = [("kb", "d", "d.txt", i, t) for i, t in zip(indexes or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "kb_id string, doc_id string, source string, page_index int, markdown string")


def page_lists(pages, size, cut=chunking.chunk_recursive):
    parents = cut(chunking.join_pages(pages), size)
    touched = chunking.chunk_pages(parents, chunking.page_spans(pages))
    rows = parents.join(touched, ["doc_id", "parent_id"]).orderBy("seq").collect()
    return [r["pages"] for r in rows]


@pytest.mark.parametrize("texts, size, pages", [
    (("alpha", "beta", "gamma"), 1000, [[0, 1, 2]]),
    (("A" * 300, "B" * 300, "C" * 300), 650, [[0, 1], [2]]),
    (("A" * 350, "B" * 350), 400, [[0], [1]]),
])
def test_page_attribution(spark, texts, size, pages):
    assert page_lists(paged(spark, *texts), size) == pages


def test_page_index_is_kept(spark):
    assert page_lists(paged(spark, "alpha", "beta", indexes=[5, 9]), 1000) == [[5, 9]]


def test_long_pages_span_stretches(spark):
    got = page_lists(paged(spark, "A" * 9000, "B" * 50, "C" * 9000), 5000, chunking.chunk_fixed)
    assert got == [[0], [0, 1, 2], [2], [2]]


def test_no_pages_no_rows(spark):
    documents = spark.createDataFrame([("kb", "d", "s", "")], "kb_id string, doc_id string, source string, text string")
    for cut in (chunking.chunk_fixed, chunking.chunk_recursive):
        assert cut(documents).count() == 0


def test_invariants(spark):
    pages = paged(spark, "A" * 900, "B" * 900, "hello world. " * 80)
    parents = chunking.chunk_recursive(chunking.join_pages(pages), 300).collect()
    children = chunking.chunk_children(chunking.chunk_recursive(chunking.join_pages(pages), 300)).collect()
    by_id = {p["parent_id"]: p for p in parents}
    assert {c["parent_id"] for c in children} == set(by_id)
    assert all(c["content"] in by_id[c["parent_id"]]["content"] for c in children)
    assert max(len(p["content"]) for p in parents) <= 300
    ids = [c["child_id"] for c in children] + list(by_id)
    assert len(ids) == len(set(ids))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.<p>", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_spans_fit_and_cover(text, size, overlap):
    for breaks in (TEXT_BREAKS, TAG_BREAKS):
        spans = split_spans(text, size, overlap, breaks)
        assert all(0 < e - s <= size for s, e in spans)
        covered = {i for s, e in spans for i in range(s, e)}
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
        if overlap == 0:
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_words_are_cut_last(spark):
    spans = split_spans("one two\n\nthree " + "x" * 12, 10, 0, TEXT_BREAKS)
    text = "one two\n\nthree " + "x" * 12
    assert [text[s:e] for s, e in spans] == ["one two", "three", "xxxxxxxxx", "xxx"]


def brute_windows(text, size, overlap):
    out, at = [], 0
    while True:
        piece = text[at:at + size].strip()
        if piece:
            out.append(piece)
        if at + size >= len(text):
            return out
        at += size - overlap


def test_plain_children_are_windows(spark):
    texts = ["x", "ab " * 400, "y" * 512, "z" * 513, " lead and trail "]
    rows = [("kb", i, "s", f"p{i}", 0, 0, t) for i, t in enumerate(texts)]
    parents = spark.createDataFrame(rows, "kb_id string, doc_id int, source string, parent_id string, seq int, start int, content string")
    got = chunking.chunk_children(parents).orderBy("doc_id", "seq").collect()
    for i, text in enumerate(texts):
        assert [r["content"] for r in got if r["doc_id"] == i] == brute_windows(text, 512, 40)


def test_tagged_children_break_at_tags(spark):
    html = "<div>" + "a" * 300 + "</div><div>" + "b" * 300 + "</div>"
    rows = [("kb", 1, "s", "p", 0, 0, html)]
    parents = spark.createDataFrame(rows, "kb_id string, doc_id int, source string, parent_id string, seq int, start int, content string")
    got = [r["content"] for r in chunking.chunk_children(parents).orderBy("seq").collect()]
    assert got == ["<div>" + "a" * 300 + "</div>", "<div>" + "b" * 300 + "</div>"]


def topics(df):
    b = F.contains("context", F.lit("TOPIC_B"))
    axis = lambda x, y: F.array(F.lit(x), F.lit(y)).cast("array<float>")
    return df.withColumn("embedding", F.when(b, axis(0.0, 1.0)).otherwise(axis(1.0, 0.0)))


def test_semantic_cut_and_cap(spark):
    text = " ".join(["A plain sentence here."] * 30 + ["TOPIC_B is spoken of now."] * 30)
    documents = spark.createDataFrame([("kb", "d", "s", text)], "kb_id string, doc_id string, source string, text string")
    parents = chunking.chunk_semantic(documents, topics, 100, 5000).orderBy("seq").collect()
    assert len(parents) == 2 and "TOPIC_B" not in parents[0]["content"].rsplit(".", 2)[0]
    capped = chunking.chunk_semantic(documents, topics, 100, 200).orderBy("seq").collect()
    assert max(len(p["content"]) for p in capped) <= 200
    assert all(text[p["start"]:p["start"] + len(p["content"])] == p["content"] for p in capped)


def test_reassemble(spark):
    rows = [("d", 0, "hello wor"), ("d", 1, "world, and"), ("d", 2, "nothing shared"), ("e", 0, "only")]
    chunks = spark.createDataFrame([("kb", *r) for r in rows], "kb_id string, doc_id string, seq int, content string")
    got = {r["doc_id"]: r for r in chunking.reassemble(chunks).collect()}
    assert got["d"]["text"] == "hello world, and\n\nnothing shared"
    assert [(r["start"], r["end"]) for r in got["d"]["ranges"]] == [(0, 9), (9, 16), (16, 32)]
    assert got["e"]["text"] == "only"


def test_one_file_in_two_bases(spark):
    """The same document id in two bases stays two documents, whatever is derived from its pages."""
    pages = spark.createDataFrame(
        [(kb, "d", "d", i, t) for kb, texts in (("a", ["abc", "defg"]), ("b", ["uvwxyz", "rs"])) for i, t in enumerate(texts)],
        "kb_id string, doc_id string, source string, page_index int, markdown string",
    )
    spans = {(r.kb_id, r.page_index): (r.start, r.end) for r in chunking.page_spans(pages).collect()}
    assert spans == {("a", 0): (0, 3), ("a", 1): (5, 9), ("b", 0): (0, 6), ("b", 1): (8, 10)}
    parents = chunking.chunk_fixed(chunking.join_pages(pages), 100)
    touched = {(r.kb_id, tuple(r.pages)) for r in chunking.chunk_pages(parents, chunking.page_spans(pages)).collect()}
    assert touched == {("a", (0, 1)), ("b", (0, 1))}
    whole = {r.kb_id: r.text for r in chunking.reassemble(parents).collect()}
    assert whole == {"a": "abc\n\ndefg", "b": "uvwxyz\n\nrs"}


def test_many_children_keep_their_order(spark):
    pieces = [(1, "d", p, c, f"<{p}.{c}>") for p in (0, 1) for c in range(1500)]
    rows = spark.createDataFrame(pieces, "kb_id int, doc_id string, parent int, child int, content string")
    text = chunking.reassemble(rows.selectExpr("kb_id", "doc_id", "struct(parent, child) AS seq", "content")).first().text
    assert text == "\n\n".join(p[-1] for p in pieces)


def test_joining_takes_time_in_proportion(spark):
    """20,000 overlapping chunks of one document; overlaps by a plain search on a part of them."""
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("ab é\n"), 300_000))
    cuts = list(range(0, 300_000, 15))
    chunks = [text[c : c + 40] for c in cuts]

    def seconds(n):
        start = time.perf_counter()
        whole, spans = splitting.joined(chunks[:n])
        return time.perf_counter() - start, whole, spans

    seconds(1000)
    (short, *_), (long, whole, spans) = seconds(5000), seconds(20_000)
    assert long < 8 * short + 0.5
    assert [spans[i][1] == spans[i + 1][0] for i in range(len(spans) - 1)] and whole[: len(text) // 2] == text[: len(text) // 2]
    rows = spark.createDataFrame([("kb", "d", i, t) for i, t in enumerate(chunks)], "kb_id string, doc_id string, seq int, content string")
    assert chunking.reassemble(rows).first().text == whole


def test_overlaps_equal_a_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(300):
        chunks = ["".join(rng.choice(list("ab"), rng.integers(0, 9))) for _ in range(rng.integers(1, 9))]
        text, expected = "", []
        for c in chunks:
            shared = next((k for k in range(min(len(text), len(c)), 0, -1) if text.endswith(c[:k])), 0)
            part = ("\n\n" if text and not shared else "") + c[shared:]
            expected.append((len(text), len(text) + len(part)))
            text += part
        assert splitting.joined(chunks) == (text, expected)


def test_distances_of_many_sentences_at_once(spark):
    """No lambda runs per number of a vector; missing and zero vectors are as far as can be."""
    rows = [("kb", 1, i, v) for i, v in enumerate([[3.0, 4.0], [4.0, 3.0], [0.0, 0.0], None, [0.0, 1.0], [0.0, 2.0]])]
    embedded = spark.createDataFrame(rows, "kb_id string, doc_id long, pos int, embedding array<float>")
    marked = chunking.semantic_breaks(embedded.withColumn("sentence", F.lit("")).withColumn("context", F.lit("")))
    assert "lambda" not in marked._jdf.queryExecution().toString()
    assert [r["distance"] for r in marked.orderBy("pos").collect()] == [0.04, 1.0, None, 1.0, 0.0, None]
