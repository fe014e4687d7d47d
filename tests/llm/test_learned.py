"""Operators that learn: held-out quality, exact parts, and edge cases."""

import os
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import compression_classifier, log_bilinear
from tidemark.llm.bindings import Q

from . import brute

WIDER = "/root/testdata/sf0.01"
ROOT = Path(__file__).parents[2]


def test_classifier_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{WIDER}/labels.parquet").collect()}
    rows = Q["op5_compression_classifier"](spark, WIDER).collect()
    assert all(r.held_out == (brute.fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([y == p for y, _, p in held]) > 0.85
    good, bad = ([s for y, s, _ in held if y == side] for side in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_classifier_at_the_edges(spark, edge_docs):
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(1, 17)] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, text int")
    rows = compression_classifier.score(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (2, 3)}
    assert len(empty) == 1
    one_sided = compression_classifier.score(edge_docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one_sided}) == 1
    assert compression_classifier.score(edge_docs.where("false"), labels).count() == 0
    assert compression_classifier.score(edge_docs, labels.where("false")).count() == len(rows)


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: r.score for r in compression_classifier.score(docs, x).collect()} for x in (labels, other))
    assert a == pytest.approx(b)


@pytest.mark.parametrize("shipped", [log_bilinear.SHIPPED, 600])
def test_unigram_parts(spark, sf, plain_texts, monkeypatch, shipped):
    monkeypatch.setattr(log_bilinear, "SHIPPED", shipped)
    expected = brute.unigram(plain_texts)
    rows = Q["op10_log_bilinear"](spark, sf).collect()
    assert len(rows) == len(expected)
    for r in rows:
        n, known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, abs=1e-6)
        assert r.held_out == (brute.fold(r.doc_id, 7) == 2) and r.score < 0


def test_scores_at_the_edges(edge_docs, edge_texts):
    rows = log_bilinear.score(edge_docs, rounds=1).collect()
    assert len(rows) == edge_docs.count()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert log_bilinear.score(edge_docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def fitted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("crc32(CAST(doc_id AS string)) % 7 <> 2")
    return log_bilinear.fit(docs, log_bilinear.token_counts(docs))


def plain_log10(model, hashes, n_known):
    """log10 of a text's tokens one by one, from the fitted numbers alone. hashes: of its tokens."""
    exp, dot = np.exp, lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b))
    size = log_bilinear.SIZE
    own = {int(h): i for i, h in enumerate(model.classes)}
    word = {int(h): i for i, h in enumerate(model.words)}
    counts = {int(h): int(n) for h, n in zip(model.hashes, model.counts)}
    m, v, total, latest = model.model, len(own) + 1, 0.0, [len(own) + 1] * 2
    others = model.rest_total + model.rest_distinct + 1
    for h in map(int, hashes):
        context = m.words[latest[0]] * m.scales[0] + m.words[latest[1]] * m.scales[1]
        scores = m.outputs @ context + m.biases
        k = own.get(h, v - 1)
        p = float(exp(scores[k] - scores.max()) / exp(scores - scores.max()).sum())
        if k == v - 1:
            centre = model.middle[int(((model.middle - context) ** 2).sum(axis=1).argmin())]
            level = model.weights[:, :size].astype(float) @ centre + model.weights[:, size]
            p *= float(exp(level[word.get(h, len(word))]) / exp(level).sum())
            if h not in word:
                p *= (counts.get(h, n_known.get(h, 0)) + 1) / others
        else:
            latest = [latest[1], k]
        total += np.log10(p)
    return total


def test_scores_equal_a_plain_forward_pass(spark, sf, fitted, plain_texts):
    import pyarrow as pa

    texts = {i: t for i, t in list(plain_texts.items())[:25] if t is None or len(t) < 3000}
    splitter = log_bilinear.Splitter(log_bilinear.SPACED)
    tokens = lambda t: log_bilinear.tokens_of(pa.array([t], pa.string()), splitter)[0]
    all_counts = {}
    for i, t in plain_texts.items():
        if brute.fold(i, 7) != 2:
            for h in map(int, tokens(t)):
                all_counts[h] = all_counts.get(h, 0) + 1
    got = {r.doc_id: r.score for r in Q["op10_log_bilinear"](spark, sf).collect()}
    for i, t in texts.items():
        assert got[i] == pytest.approx(plain_log10(fitted, tokens(t), all_counts), rel=2e-3)


def test_all_tokens_share_one(fitted):
    """Classes, words, and the rest with an unseen token: probabilities after some text sum to 1."""
    start = np.concatenate([fitted.classes[:2], fitted.words[:1], fitted.classes[5:6]])
    every = np.concatenate([fitted.classes, fitted.words, np.array([1], np.uint64)])
    total = 0.0
    for token in every:
        logs, rest = fitted.log_probabilities(np.append(start, token), np.array([0, len(start) + 1]))
        assert rest[-1] == (token == 1)
        total += np.exp(logs[-1])
    assert total == pytest.approx(1, abs=1e-4)


def test_the_vocabulary_grows(fitted, spark):
    docs = spark.read.parquet(f"{WIDER}/documents.parquet")
    counts = log_bilinear.token_counts(docs)
    more = log_bilinear.most_frequent(counts, log_bilinear.SHIPPED)[0]
    assert len(more) > 1.5 * len(fitted.hashes) and len(more) == counts.where("c > 1").count()


def test_held_out_texts_are_likelier_than_by_unigrams(spark):
    rows = [r for r in Q["op10_log_bilinear"](spark, WIDER).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.1


def test_words_learn_their_states():
    """Words that occur in one state get most of its probability, exactly as often as they occur in all."""
    rng = np.random.default_rng(6)
    middle = rng.normal(0, 1, (4, log_bilinear.SIZE))
    n = np.kron(np.eye(4), np.ones((5, 1))) * 40 + 1
    weights = log_bilinear.estimate(n, n.sum(axis=0), middle)
    norm = log_bilinear.normalisers(weights, middle)
    p = np.exp(middle @ weights[:, :-1].T + weights[:, -1] - norm[:, None])
    assert p.sum(axis=1) == pytest.approx(1) and all(p[s, 5 * s : 5 * s + 5].sum() > 0.7 for s in range(4))


@pytest.mark.parametrize("name", ["op10_log_bilinear", "op5_compression_classifier"])
def test_workers_need_no_package_on_their_path(sf, tmp_path, name):
    """Started outside the folder, with nothing on the path: executors get what they need by value."""
    import subprocess
    import sys

    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / 'shared')!r}).getOrCreate()
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {str(ROOT / '__spark_entry__.py')!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
print("rows", entry.queries()[{name!r}](spark, {sf!r}).count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    noise = rng.random(40)
    vocabulary = log_bilinear.Vocabulary(np.sort(rng.integers(1, 1 << 60, 39).astype(np.uint64)), noise / noise.sum())
    model = log_bilinear.Model(vocabulary)
    model.flat += rng.normal(0, 0.5, len(model.flat))
    model = log_bilinear.Model(vocabulary, model.flat)
    logs = model.log_probabilities(np.full(40, 3), np.full(40, 40), np.arange(40), model.normalisers())
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)


def test_training_learns_what_follows():
    """Two languages of one alphabet: contexts tell them apart, single words do not."""
    rng = np.random.default_rng(2)
    vocabulary = log_bilinear.Vocabulary(np.arange(20, dtype=np.uint64), np.full(21, 1 / 21))
    language = rng.integers(0, 2, 4000)
    before, last, target = (rng.integers(0, 10, 4000) + 10 * language for _ in range(3))
    model = log_bilinear.Model(vocabulary)
    trainer = log_bilinear.Trainer(model, vocabulary, 0)
    for _ in range(30):
        for i in range(0, 4000, 500):
            s = slice(i, i + 500)
            trainer.step(before[s], last[s], target[s], np.ones(500))
    assert model.log_probabilities(before, last, target, model.normalisers()).mean() > -np.log(21) + 0.5
