import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.config import KbConfig
from tidemark.functions import hooks
from tidemark.plans import skew
from tidemark.plans.corpus import build_corpus
from tidemark.sources import files
from tidemark.sources.store import Index


def test_archives(spark, tmp_path):
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr("docs/a.txt", f"text {n} é")
            for junk in ("__MACOSX/a", ".DS_Store", "x/Thumbs.db", "x/.hidden/b.txt", "x/Desktop.INI"):
                z.writestr(junk, "junk")
            z.writestr("folder/", "")
            z.writestr("nul.txt", b"a\0b")
            z.writestr("bad.txt", b"\xff\xfe")
            z.writestr("empty.txt", "")
    (tmp_path / "note.txt").write_text("no archive")
    got = sorted((r["name"], r["text"]) for r in files.read_archives(spark, str(tmp_path)).collect())
    assert got == sorted([("docs/a.txt", f"text {n} é") for n in range(3)] + [("empty.txt", "")] * 3)


def test_lenient_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff end")
    (row,) = files.read_text_files(spark, str(tmp_path), "kb").collect()
    assert (row["source"], row["page_index"], row["markdown"]) == ("a.txt", 0, b"ok \xff end".decode("utf-8", "replace"))


def test_blank_pages_take_what_was_read(spark):
    pages = spark.createDataFrame([("d", 0, "own"), ("d", 1, "  "), ("d", 2, None)], "doc_id string, page_index int, markdown string")
    read = spark.createDataFrame([("d", 0, "never"), ("d", 1, "from image")], "doc_id string, page_index int, ocr_text string")
    assert [r["page_index"] for r in files.blank_pages(pages).orderBy("page_index").collect()] == [1, 2]
    got = files.merge_page_text(pages, read).orderBy("page_index").collect()
    assert [r["markdown"] for r in got] == ["own", "from image", None]


def test_nested_json(spark, tmp_path):
    question = {"id": "q1", "question": "When?", "answer": "Now", "type": "literal", "source_doc": "d.pdf",
                "relevant": [{"page": 1, "section": "s", "gold_text": "g1"}, {"page": 2, "section": "t", "gold_text": "g2"}]}
    (tmp_path / "q.jsonl").write_text(json.dumps(question) + "\n")
    (tmp_path / "d.json").write_text(json.dumps({"filename": "d", "chunks": [{"seq": 0, "content": "a"}, {"seq": 1, "content": "b"}]}, indent=1))
    rows = files.read_eval_questions(spark, str(tmp_path / "q.jsonl")).orderBy("page").collect()
    assert [(r["id"], r["page"], r["gold_text"]) for r in rows] == [("q1", 1, "g1"), ("q1", 2, "g2")]
    chunks = files.read_document_chunks(spark, str(tmp_path / "d.json")).orderBy("seq").collect()
    assert [(r["filename"], r["content"]) for r in chunks] == [("d", "a"), ("d", "b")]


def test_writes_replace_only_their_own(spark, tmp_path):
    def pairs(dataset, question):
        return spark.createDataFrame([("f", "c", question, "a", "simple", ["x"], dataset)],
                                     "source_file string, context string, question string, answer string, category string, labels array<string>, dataset_id string")

    out = str(tmp_path / "pairs")
    files.write_pairs(pairs("d1", "one"), out)
    files.write_pairs(pairs("d2", "two"), out)
    files.write_pairs(pairs("d1", "new"), out)
    got = {(r["dataset_id"], r["question"]) for r in files.read_pairs(spark, out).collect()}
    assert got == {("d1", "new"), ("d2", "two")}
    (tmp_path / "blob.bin").write_bytes(b"\x01\x02")
    assert bytes(files.load_blob(spark, str(tmp_path), "blob.bin").head()["content"]) == b"\x01\x02"


def test_embedding_hook_batches_and_keeps_order(spark):
    def make():
        def call(texts):
            assert len(texts) <= hooks.DENSE_BATCH
            return [[float(len(t)), float(len(texts))] for t in texts]
        return call

    df = spark.createDataFrame([(i, "x" * i) for i in range(70)], "i int, text string").coalesce(1)
    got = hooks.embedded(df, "text", make).orderBy("i").collect()
    assert [r["embedding"][0] for r in got] == [float(i) for i in range(70)]
    tokens = hooks.embedded(df, "text", lambda: lambda texts: [[[1.0]] * (len(t) % 3) for t in texts], per_token=True)
    assert [len(r["embedding"]) for r in tokens.orderBy("i").collect()] == [i % 3 for i in range(70)]


def test_embedding_failures_surface(spark):
    df = spark.createDataFrame([(1, "x")], "i int, text string")
    with pytest.raises(Exception, match="one vector per text"):
        hooks.embedded(df, "text", lambda: lambda texts: []).collect()


def test_pair_scorer(spark):
    df = spark.createDataFrame([(0, "a", "aab"), (1, "b", "aab"), (2, "a", None), (3, "a", "a")], "i int, q string, t string")
    score = hooks.pair_scorer(lambda: lambda q, texts: [float(t.count(q)) for t in texts])
    got = df.select("i", score(F.col("q"), F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [2.0, 1.0, 0.0, 1.0]


def test_writer_hook(spark):
    df = spark.createDataFrame([("f1", 2), ("f2", 0)], "file string, n int")
    make = lambda: lambda row: [{"file": row["file"], "slot": i + 1} for i in range(row["n"])]
    assert sorted(map(tuple, hooks.written(df, make, "file string, slot int").collect())) == [("f1", 1), ("f1", 2)]


@pytest.mark.parametrize("status, calls", [(429, 4), (503, 4), (None, 4), (400, 1)])
def test_retry(status, calls):
    seen, waits = [], []

    def call():
        seen.append(1)
        raise hooks.TransientError("no", status)

    with pytest.raises(hooks.TransientError):
        hooks.with_retry(call, waits.append)()
    assert len(seen) == calls and waits == [1.0, 2.0, 4.0][:calls - 1]


def test_measured_side(spark):
    df = spark.createDataFrame([("x" * 100, [1, 2])] * 100, "s string, a array<int>")
    assert skew.small_enough(df, 20_000) and not skew.small_enough(df, 10_000)


def test_pages_of_white_space_are_blank(spark):
    pages = spark.createDataFrame(
        [("a", "d", 0, "\n \t\n"), ("a", "d", 1, "text"), ("b", "d", 0, "\u3000")], "kb_id string, doc_id string, page_index int, markdown string"
    )
    assert {(r.kb_id, r.page_index) for r in files.blank_pages(pages).collect()} == {("a", 0), ("b", 0)}
    read = spark.createDataFrame([("a", "d", 0, "read a"), ("b", "d", 0, "read b")], "kb_id string, doc_id string, page_index int, ocr_text string")
    merged = {(r.kb_id, r.page_index): r.markdown for r in files.merge_page_text(pages, read).collect()}
    assert merged == {("a", 0): "read a", ("a", 1): "text", ("b", 0): "read b"}


def test_intermediate_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    folder = tmp_path / "written"
    monkeypatch.setattr(skew, "written_folder", lambda _: str(folder))
    assert skew.materialize(spark.range(3), "few").count() == 3 and folder.is_dir()
    skew.drop_written(spark)
    assert not folder.exists()


@pytest.fixture
def refusing():
    def make():
        def call(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no " + "x" * 3000 if "long" in texts[0] else "")
            return [[float(len(t))] for t in texts]
        return call

    return make


def test_a_failed_text_fails_alone(spark, refusing):
    texts = ["good", "bad", "long bad", *["fine"] * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = hooks.embedded(df, "text", refusing, error="error").orderBy("i").collect()
    assert [r["embedding"] for r in got] == [None if "bad" in t else [float(len(t))] for t in texts]
    assert got[1]["error"] == "ValueError" and got[2]["error"] == ("no " + "x" * 3000)[:2000] and got[0]["error"] is None


def test_a_failed_writer_leaves_a_row(spark):
    def make():
        def write(row):
            if row["n"] < 0:
                raise RuntimeError("cannot")
            return [{"file": row["file"], "slot": i + 1} for i in range(row["n"])]
        return write

    df = spark.createDataFrame([("f1", 2), ("f2", -1), ("f3", 1)], "file string, n int")
    got = hooks.written(df, make, "file string, slot int", error="error", keys=["file"]).collect()
    assert sorted(map(tuple, got), key=str) == [("f1", 1, None), ("f1", 2, None), ("f2", None, "cannot"), ("f3", 1, None)]


def test_failed_files_are_listed_and_left_out(spark, tmp_path, refusing):
    rows = [("kb", "a", "a", "good text"), ("kb", "b", "b", "x" * 1000 + " bad " + "y" * 1000), ("kb", "c", "c", "bad bad")]
    docs = spark.createDataFrame(rows, "kb_id string, doc_id string, source string, text string")
    embed = lambda df: hooks.embedded(df, next(c for c in ("context", "content") if c in df.columns), refusing, error="error")
    for base in (
        KbConfig(indexes=("bm25", "m")),
        KbConfig(indexes=("bm25", "m"), chunking_method="semantic", chunking_model_id="m"),
    ):
        built = build_corpus(docs, base, {"m": embed})
        assert sorted((r["doc_id"], r["stage"], r["error"]) for r in built.failed.collect()) == [("b", "m", "ValueError"), ("c", "m", "ValueError")]
        for table in (built.parents, built.children, built.terms):
            assert {r["doc_id"] for r in table.collect()} == {"a"}
        assert built.dense["m"].count() == 1 and {r["n_children"] for r in built.idf.collect()} == {1}
    stored = Index(spark, str(tmp_path / "index"))
    stored.put(built, docs)
    assert {r["doc_id"] for r in stored.open().failed.collect()} == {"b", "c"}
    good = docs.where("doc_id = 'c'").withColumn("text", F.lit("fine now"))
    stored.put(build_corpus(good, base, {"m": embed}), good)
    assert {r["doc_id"] for r in stored.open().failed.collect()} == {"b"} and stored.open().parents.count() == 2


def test_broken_archives_do_not_stop_a_scan(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a.txt", "text a")
        z.writestr("b.txt", "text b" * 50)
    data = bytearray((tmp_path / "good.zip").read_bytes())
    data[data.index(b"text b") + 3] ^= 255  # the checksum of one entry no longer fits
    (tmp_path / "part.zip").write_bytes(bytes(data))
    (tmp_path / "none.zip").write_bytes(b"no archive")
    read = {(r["archive"].rsplit("/", 1)[1], r["name"]) for r in files.read_archives(spark, str(tmp_path)).collect()}
    assert read == {("good.zip", "a.txt"), ("good.zip", "b.txt"), ("part.zip", "a.txt")}
    broken = {(r["archive"].rsplit("/", 1)[1], r["name"]): r["error"] for r in files.broken_entries(spark, str(tmp_path)).collect()}
    assert set(broken) == {("part.zip", "b.txt"), ("none.zip", None)} and all(broken.values())


def test_blobs_by_key(spark, tmp_path):
    root = str(tmp_path / "blobs")
    blobs = spark.createDataFrame([("kb1/f1", bytearray(b"one")), ("kb1/f2", bytearray(b"\x00\xff")), ("datasets/d/source.zip", bytearray(b"zip"))], "key string, content binary")
    assert files.save_blobs(blobs, root) == 3
    assert files.save_blobs(spark.createDataFrame([("kb1/f1", bytearray(b"new"))], "key string, content binary"), root) == 1
    load = lambda key: bytes(files.load_blob(spark, root, key).head()["content"])
    assert (load("kb1/f1"), load("kb1/f2"), load("datasets/d/source.zip")) == (b"new", b"\x00\xff", b"zip")
    assert files.delete_blobs(spark, root, "kb1/f1") and not files.delete_blobs(spark, root, "kb1/f1")
    assert files.delete_blobs(spark, root, "kb1") and load("datasets/d/source.zip") == b"zip"
