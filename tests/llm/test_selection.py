"""Importance resampling, packing and spelling groups, against plain versions."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from tidemark.llm import best_fit_packing, importance_resampling, spelling_groups
from tidemark.llm.bindings import Q, tokenizer

from . import brute

# --- importance resampling ---


def test_resampling_of_the_table(spark, sf, plain_texts):
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in Q["op11_importance_resampling"](spark, sf).collect()]
    assert sorted(got, key=str) == brute.resampled(plain_texts.items(), target)


@pytest.mark.parametrize("block", [importance_resampling.BLOCK, 1, 2, 7])
def test_resampling_at_the_edges(spark, edge_docs, edge_texts, monkeypatch, block):
    """Nulls, empty and very long texts, repeated rows; blocks of words that end anywhere."""
    monkeypatch.setattr(importance_resampling, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in edge_docs.collect() if block > 100 or len(r.text or "") < 5000]
    docs = spark.createDataFrame([Row(doc_id=k, text=t, weight="w", rank=1, bucket=2) for k, t in rows], "doc_id long, text string, weight string, rank int, bucket int")
    target = spark.createDataFrame([("brown fox jumps over",), (None,), ("",)], "text string")
    found = importance_resampling.resample(docs, target).collect()
    got = [(r.id, r.n_features, r.weight, r.score, r["rank"]) for r in found]
    assert sorted(got, key=str) == brute.resampled(rows, ["brown fox jumps over", None, ""])


def test_drawn_documents_keep_their_columns(spark, edge_docs):
    many = spark.createDataFrame([Row(doc_id=i // 4, text="the quick brown fox " * 6 + f"w{i // 8}", rank=i, id="x") for i in range(400)] )
    target = spark.createDataFrame([("brown fox",)], "text string")
    found = importance_resampling.resample(many, target)
    drawn = importance_resampling.drawn(many, target)
    assert drawn.columns == many.columns and drawn.count() == 20 == found.where("rank IS NOT NULL").count()
    best = [r.id for r in found.where("rank IS NOT NULL").orderBy("rank").collect()]
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(best)
    assert importance_resampling.resample(edge_docs.where("false"), target).count() == 0
    assert importance_resampling.resample(edge_docs, target.where("false")).count() == edge_docs.count()


def test_target_like_documents_are_drawn_more(spark):
    rng = np.random.default_rng(3)
    kind = lambda k, n: " ".join(f"{k}{i}" for i in rng.integers(0, 50, n))
    docs = spark.createDataFrame([(i, kind("good" if i % 4 == 0 else "other", 60)) for i in range(800)], "doc_id long, text string")
    target = spark.createDataFrame([(kind("good", 500),)], "text string")
    assert all(r.doc_id % 4 == 0 for r in importance_resampling.drawn(docs, target).collect())


# --- packing ---


@pytest.fixture(scope="module")
def encoded():
    load = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    return lambda text: load.encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(rows, ids_of, length=2048):
    """Every id of every document once and in order; sequences without gaps, as few as best fit decreasing finds, or nearly."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for key, ids in ids_of.items():
        at = 0
        first = len(ids) % length or length
        for k, r in enumerate(sorted(by_doc[key], key=lambda r: r.piece)):
            cut = ids[r.start : r.start + r.length]
            assert (r.piece, r.start, r.length) == (k, at, length if k else first)
            assert r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    plain = brute.best_fit_decreasing([r.length for r in rows], length)
    assert len(by_sequence) <= plain + max(1, plain // 100)


def test_packing_of_the_table(spark, sf, plain_texts, encoded):
    rows = Q["op12_best_fit_packing"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(plain_texts)
    check_packing(rows, {i: encoded(t) for i, t in plain_texts.items()})


def test_packing_at_the_edges(spark, edge_docs, edge_texts, encoded, monkeypatch):
    monkeypatch.setattr(best_fit_packing, "CACHED", 50)
    monkeypatch.setattr(best_fit_packing, "GROUP", 3)
    docs = edge_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = best_fit_packing.pack(docs, tokenizer("byte_bpe_50k.json"), length=100).withColumnRenamed("sequence_id", "s").selectExpr("*", "id AS doc_id", "s AS sequence_id").collect()
    check_packing(rows, {i: encoded(t) for i, t in edge_texts.items()}, 100)
    cut = best_fit_packing.pieces(edge_docs, tokenizer("byte_bpe_50k.json"), with_ids=True, length=100)
    whole = best_fit_packing.sequences(cut, 100).collect()
    total = sum(len(encoded(r.text)) for r in edge_docs.collect())
    assert sum(r.n_tokens for r in whole) == total and all(r.n_tokens <= 100 and len(r.tokens) == 2 * r.n_tokens and r.starts[0] == 0 for r in whole)
    assert best_fit_packing.pack(edge_docs.where("false"), tokenizer("byte_bpe_50k.json")).count() == 0


def test_parts_encode_as_whole_texts(encoded):
    encode = best_fit_packing.part_encoder(best_fit_packing.Loader(tokenizer("byte_bpe_50k.json")), "<u2")
    texts = [
        "", " ", "  a  b ", "a\n\n  b\r\n c\t\td", "it's we'll 'tis 12 345,6 !!! ?  . end  \n", "naïve  café\u00a0\u2003x\u3000y", "a\x1cb !\x1c! \x1d x\x85y",
        "x<|endoftext|>y <|endoftext|>", "日本語 テキスト 😀😀 a\u200bb\ufeffc", "\u180e a \u180eb", " 's 's\n's", "tab\tspace \t mix\n\n\n\nend", "\u2028a\u2029 b \x0b\x0c c", "\x1cab !", "\x1f! \x1e", "a! \x1d!",
    ]
    rng = np.random.default_rng(7)
    marks = ["a", "B", "'s", " ", "  ", "\n", "\t", "1", "é", "!", "\u00a0", "\u2003", "\x1f", "\x85", "'", "中", "\u200b"]
    texts += ["".join(rng.choice(marks, 40)) for _ in range(400)]
    assert [np.frombuffer(ids, "<u2").tolist() + [0] for ids in encode(texts)] == [encoded(t) for t in texts]


@pytest.mark.parametrize("sizes", [
    [1] * 5000, [700] * 300 + [1400] * 200, [1024] * 7 + [1025] * 5 + [2048] * 3, [2047, 1, 1], list(range(1, 2049, 3)), [683] * 100 + [682] * 100 + [10] * 50,
])
def test_places_of_given_sizes(spark, sizes):
    rows = [(i, s, i, 0, 0) for i, s in enumerate(sizes)]
    got = best_fit_packing.place(spark.createDataFrame(rows, "row long, length long, id long, version long, piece int")).collect()
    assert sorted(r.row for r in got) == list(range(len(sizes)))
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence].append((r["at"], sizes[r.row]))
    for held in spans.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
    plain = brute.best_fit_decreasing(sizes)
    assert len(spans) <= plain + max(1, plain // 100)


# --- spelling groups ---


def spelled(rows):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_spellings_of_the_table(spark, sf, plain_texts):
    assert spelled(Q["op13_spelling_groups"](spark, sf).collect()) == brute.spellings(plain_texts.items())


def test_spellings_at_the_edges(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()] * 6
    docs = spark.createDataFrame([Row(doc_id=k, text=t, word=1, n="n") for k, t in rows], "doc_id long, text string, word int, n string")
    assert spelled(spelling_groups.variants(spelling_groups.word_counts(docs, noise=7)).collect()) == brute.spellings(rows, noise=7)
    assert spelling_groups.variants(spelling_groups.word_counts(docs.where("false"))).count() == 0


@pytest.mark.parametrize("tile, parts", [(1024, 3), (8, 3), (5, 2), (16, 1)])
def test_all_near_words_are_found(spark, tile, parts):
    """Words of few letters, so that many are near, with edits at all places and keys split into tiles."""
    rng = np.random.default_rng(11)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 11))) for _ in range(700)}
    words |= {w[:i] + w[i + 1 :] for w in list(words)[:100] for i in range(len(w))} | {"x" + w for w in list(words)[:50]} | {w + "x" for w in list(words)[:50]}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.choice([5, 6, 30, 31, 200, 1100, 6000], len(words)))}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelled(spelling_groups.variants(table, parts=parts, tile=tile).collect())
    assert got == brute.spelling_forms(counts)
    assert max(v[1] for v in got.values()) > 10 and len({v[4] for v in got.values()}) < len(got)


def test_chains_of_forms_end_at_the_root(spark):
    chain = ["aaaaaa" + "b" * i for i in range(9)]
    table = spark.createDataFrame([(w, 5 * 6**i) for i, w in enumerate(chain)], "word string, n long")
    found = spelling_groups.variants(table)
    assert {r.root for r in found.collect()} == {chain[-1]}
    assert [(r.root, r.n_spellings) for r in spelling_groups.groups(found).collect()] == [(chain[-1], 9)]
