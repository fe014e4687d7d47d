import pytest
from pyspark.sql import functions as F

from tidemark.bindings.tables import HASHED, embed_hashed
from tidemark.config import KbConfig, SearchConfig
from tidemark.functions import hooks
from tidemark.operators import index as statistics
from tidemark.plans import corpus as plans
from tidemark.plans.corpus import build_corpus
from tidemark.plans.retrieval import retrieve
from tidemark.plans.skew import materialize
from tidemark.sources import store
from tidemark.sources.store import Index

BASE = KbConfig(indexes=("bm25", HASHED), reranker_type="late-interaction", reranker_model_id="late")


def late(df):
    return df.withColumn("embedding", F.array(F.array(F.length("content").cast("float"), F.lit(1.0).cast("float"))))


def docs(spark, texts, kb="kb"):
    return spark.createDataFrame([(kb, k, f"{k}.txt", t) for k, t in texts.items()], "kb_id string, doc_id long, source string, text string")


def built(documents):
    return build_corpus(documents, BASE, {HASHED: embed_hashed, "late": late})


def answers(spark, corpus):
    asked = spark.createDataFrame([(0, "kb", "coins"), (1, "kb", "old silver"), (2, "other", "coins")], "query_id long, kb_id string, text string")
    vectors = lambda q: embed_hashed(q).select("query_id", "kb_id", "embedding")
    hits = retrieve(asked, corpus, KbConfig(indexes=("bm25", HASHED)), SearchConfig(indexes=("bm25", HASHED)), {HASHED: vectors})
    return [(r["query_id"], r["rank"], r["content"], r["score"]) for r in hits.orderBy("query_id", "rank").collect()]


def rows(corpus):
    """Everything an index holds, whatever the order of columns."""
    tables = [corpus.parents, corpus.children, corpus.terms, corpus.tokens, *corpus.dense.values()]
    common = [t.drop("doc_id") if "doc_id" in t.columns else t for t in tables]
    held = [sorted(str(r.asDict()) for r in t.select(*sorted(t.columns)).collect()) for t in common]
    return held, sorted((r["kb_id"], r["term"], r["df"], r["n_children"], round(r["idf"], 9)) for r in corpus.idf.collect())


@pytest.fixture
def texts():
    return {1: "coins of old", 2: "old silver medals " * 60, 3: "pelicans", 4: "silver coins"}


def test_roundtrip_replace_and_delete_equal_a_rebuild(spark, tmp_path, texts):
    index = Index(spark, str(tmp_path / "i"))
    corpus = built(docs(spark, texts).unionByName(docs(spark, {1: "other coins"}, "other")))
    assert index.put(corpus) == 1
    assert rows(index.open()) == rows(corpus) and answers(spark, index.open()) == answers(spark, corpus)

    index.put(built(docs(spark, {2: "silver only", 5: "new coins"})))
    index.delete(spark.createDataFrame([("kb", 3), ("kb", 99), ("none", 1)], "kb_id string, doc_id long"))
    changed = {1: texts[1], 2: "silver only", 4: texts[4], 5: "new coins"}
    again = built(docs(spark, changed).unionByName(docs(spark, {1: "other coins"}, "other")))
    assert rows(index.open()) == rows(again) and answers(spark, index.open()) == answers(spark, again)

    assert rows(index.open(1)) == rows(corpus)  # the first version is still there
    index.compact()
    assert rows(index.open()) == rows(again) and len(index.version().segments) == 1 and index.version().gone == ()
    index.put(built(docs(spark, {3: "pelicans"})))
    index.delete(spark.createDataFrame([("kb", 5)], "kb_id string, doc_id long"))
    last = built(docs(spark, {1: texts[1], 2: "silver only", 3: "pelicans", 4: texts[4]}).unionByName(docs(spark, {1: "other coins"}, "other")))
    assert rows(index.open()) == rows(last)
    assert rows(Index(spark, str(tmp_path / "i")).open()) == rows(last)


def test_a_file_replaced_by_nothing_is_gone(spark, tmp_path, texts):
    index = Index(spark, str(tmp_path / "i"))
    index.put(built(docs(spark, texts)))
    index.put(built(docs(spark, {1: ""})), docs(spark, {1: ""}))
    assert {r["doc_id"] for r in index.open().parents.collect()} == {2, 3, 4}
    assert rows(index.open()) == rows(built(docs(spark, {k: t for k, t in texts.items() if k != 1})))
    with pytest.raises(ValueError):
        index.put(build_corpus(docs(spark, {9: "x"})))  # without the tables the index has


def test_writers_that_meet_both_count(spark, tmp_path, texts, monkeypatch):
    """A commit that lost its number takes the next, and counts against the version it then follows."""
    index, other = Index(spark, str(tmp_path / "i")), Index(spark, str(tmp_path / "i"))
    index.put(built(docs(spark, texts)))
    create, met = index.folder.create, []

    def late_create(name, text):
        if not met:
            met.append(other.put(built(docs(spark, {1: "coins from elsewhere"}))))
        return create(name, text)

    monkeypatch.setattr(index.folder, "create", late_create)
    assert index.put(built(docs(spark, {1: "silver at last"}))) == 3 and met == [2]
    assert rows(index.open()) == rows(built(docs(spark, {**texts, 1: "silver at last"})))


def test_an_empty_index_cannot_be_opened(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.delete(spark.createDataFrame([("kb", 1)], "kb_id string, doc_id long"))
    with pytest.raises(ValueError):
        index.open()
    index.put(built(docs(spark, {1: "coins"})))
    assert index.open().parents.count() == 1


def test_replacing_a_file_reads_its_part_of_the_terms_only(spark, tmp_path):
    """Stored terms lie in order of file, and the files concerned are pushed into the scan."""
    index = Index(spark, str(tmp_path / "i"))
    index.put(build_corpus(docs(spark, {i: f"word{i} " * 30 for i in range(400)})))
    files = spark.createDataFrame([("kb", 7)], "kb_id string, doc_id long")
    old = index._live("terms", index.version(), files)
    scan = old._jdf.queryExecution().toString()
    assert "In(doc_id, [7])" in scan or "EqualTo(doc_id,7)" in scan
    assert old.count() == 1
    idf = {r["term"]: (r["df"], r["n_children"]) for r in index.open().idf.collect()}
    assert idf == {r["term"]: (r["df"], r["n_children"]) for r in statistics.term_idf(index.open().terms).collect()}


def test_vectors_are_stored_without_a_join(spark, tmp_path):
    """A corpus knows the files of its vectors, so children are not read again to store them."""
    tables = Index(spark, str(tmp_path))._tables(built(docs(spark, {1: "coins of old"})))
    assert "Join" not in tables["dense-0"]._jdf.queryExecution().toString()
    assert {"kb_id", "doc_id", "parent_id", "child_id", "embedding"} == set(tables["dense-0"].columns)


def test_a_build_writes_each_table_once(spark, tmp_path, texts, monkeypatch):
    """The tables are stored as they are made, without a copy or a shuffle beside; the rows are those of a put."""
    written = []
    monkeypatch.setattr(store, "materialize", lambda df, name, *how: written.append(name) or materialize(df, name, *how))
    monkeypatch.setattr(plans, "materialize", lambda df, name, *how: written.append(name) or materialize(df, name, *how))
    given, embedders = docs(spark, texts), {HASHED: embed_hashed}
    config = KbConfig(indexes=("bm25", HASHED))
    one, other = Index(spark, str(tmp_path / "i")), Index(spark, str(tmp_path / "o"))
    kinds = []
    monkeypatch.setattr(Index, "_write", lambda self, rows, table, segment, ordered=False, write=Index._write: kinds.append((table, ordered)) or write(self, rows, table, segment, ordered))
    assert one.build(given, config, embedders) == 1
    assert sorted(t for t, _ in kinds) == ["children", "dense-0", "failed", "gone", "parents", "terms"]
    assert {t for t, ordered in kinds if ordered} == {"children", "dense-0", "terms"} and not written
    other.put(build_corpus(given, config, embedders))
    assert tables(one) == tables(other)
    one.build(docs(spark, {1: "", 5: "new coins"}), config, embedders, files=docs(spark, {1: "", 5: ""}))
    other.put(build_corpus(docs(spark, {1: "", 5: "new coins"}), config, embedders), docs(spark, {1: "", 5: ""}))
    assert tables(one) == tables(other) and one.open().parents.where("doc_id = 1").count() == 0
    assert one.build(given, config, embedders, batch=("w", 0)) == one.build(given, config, embedders, batch=("w", 0))
    assert tables(one) == tables(Index(spark, str(tmp_path / "i")))


def tables(index):
    held = index.open()
    every = [held.parents, held.children, held.terms, held.idf, *held.dense.values(), held.failed]
    return [sorted(str(r.asDict()) for r in t.select(*sorted(t.columns)).collect()) for t in every]


def test_a_build_leaves_out_files_that_fail(spark, tmp_path):
    """Their rows are in no table, and all others are."""

    def refusing():
        def call(texts):
            if any("@" in t for t in texts):
                raise ValueError("refused")
            return [[float(len(t))] for t in texts]

        return call

    embed = {"m": lambda df: hooks.embedded(df, "content", refusing, error="error")}
    given, config = docs(spark, {1: "coins", 2: "a@b", 3: "old silver"}), KbConfig(indexes=("bm25", "m"))
    one, other = Index(spark, str(tmp_path / "i")), Index(spark, str(tmp_path / "o"))
    one.build(given, config, embed)
    other.put(build_corpus(given, config, embed))
    assert tables(one) == tables(other)
    assert {r["doc_id"] for r in one.open().children.collect()} == {1, 3} and [r["doc_id"] for r in one.open().failed.collect()] == [2]
    good = Index(spark, str(tmp_path / "g"))
    good.build(docs(spark, {1: "coins", 3: "old silver"}), config, embed)
    assert [set(t.columns) for t in good.open().dense.values()] == [{"kb_id", "doc_id", "parent_id", "child_id", "embedding"}]


def test_stored_and_written_tables_are_packed_well(spark, tmp_path):
    """Both kinds hold whole texts and words."""
    corpus = built(docs(spark, {1: "coins of old"}))
    index = Index(spark, str(tmp_path / "i"))
    index.put(corpus)
    for table in (index.open().terms, index.open().idf, corpus.terms, corpus.parents, corpus.idf):
        assert all(".zstd." in path for path in table.inputFiles())
