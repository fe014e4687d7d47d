from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.config import KbConfig
from tidemark.operators import evalset, evaluate
from tidemark.plans.corpus import build_corpus
from tidemark.plans.experiment import run_experiment, scores_map

GOLD = "Refunds take 30 days. Contact billing."
HITS = "query_id long, rank int, parent_id string, source string, content string, score double"
PAIRS = "query_id long, source_file string, context string, category string, labels array<string>"


def score(spark, hits, context=GOLD):
    pairs = spark.createDataFrame([(0, "faq.md", context, "simple", [])], PAIRS)
    rows = [(0, i, f"p{i}", source, text, 1.0) for i, (source, text) in enumerate(hits, 1)]
    judged = evaluate.judge(spark.createDataFrame(rows, HITS), pairs)
    return evaluate.pair_scores(judged, pairs).head(), evaluate.highlights(judged).orderBy("rank").collect()


@pytest.mark.parametrize("hits, values, status", [
    ([("faq.md", "Refunds take 30 days."), ("faq.md", "Contact billing.")], (1, 1, 1, 1), "full"),
    ([("faq.md", "Nothing."), ("faq.md", "Refunds take 30 days.")], (0.5, 0.5, 1, 0.5), "partial"),
    ([("faq.md", "Nothing.")], (0, 0, 0, 0), "miss"),
    ([], (0, 0, 0, 0), "miss"),
    ([("other.md", "Refunds take 30 days.")], (0, 0, 0, 0), "miss"),
])
def test_metrics(spark, hits, values, status):
    got, _ = score(spark, hits)
    assert (got["context_precision"], got["context_recall"], got["hit_rate"], got["mrr"]) == values
    assert got["status"] == status


def test_empty_gold_is_a_miss(spark):
    got, _ = score(spark, [("faq.md", "x")], " \n ")
    assert (got["context_recall"], got["status"]) == (0, "miss")


def test_highlights_map_to_raw_text(spark):
    text = "Intro.\nRefunds  take\n๓๐ days. End."
    _, marked = score(spark, [("faq.md", text), ("faq.md", "no")])
    (span,) = marked[0]["highlights"]
    assert text[span["start"]:span["end"]] == "Refunds  take\n๓๐ days."
    assert marked[1]["highlights"] == []


def test_means_and_breakdowns(spark):
    rows = [(0, "simple", ["a", "a", "b"], 1.0, 1.0, 1.0, 1.0, "full"), (1, "simple", [], 0.0, 0.0, 1.0, 0.0, "miss")]
    scores = spark.createDataFrame(rows, "query_id long, category string, labels array<string>, context_precision double, context_recall double, hit_rate double, mrr double, status string")
    means = {r["metric"]: r["score"] for r in evaluate.run_scores(scores, ["mrr", "hit_rate"]).collect()}
    assert means == {"mrr": 0.5, "hit_rate": 1.0}
    assert evaluate.run_scores(scores.where("false")).count() == 0
    by_label = {r["label"]: (r["pairs"], r["score"]) for r in evaluate.breakdown_by_label(scores).collect()}
    assert by_label == {"a": (1, 1.0), "b": (1, 1.0), "untagged": (1, 0.25)}
    (row,) = evaluate.breakdown_by_category(scores).collect()
    assert (row["category"], row["pairs"], row["score"]) == ("simple", 2, 0.625)
    assert [r["query_id"] for r in evaluate.filter_pairs(scores, label="untagged").collect()] == [1]
    assert [r["query_id"] for r in evaluate.filter_pairs(scores, "simple", "b", "full").collect()] == [0]


def test_run_history(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [
        (1, "d", day(1), "success", {"mrr": 0.4}), (2, "d", day(2), "failed", {"mrr": 0.9}),
        (3, "d", day(3), "success", {"mrr": 0.3, "hit_rate": 0.5}), (4, "d", day(3), "success", {"mrr": 0.8}),
        (5, "d", day(4), "success", {"hit_rate": 0.6}), (6, "other", day(2), "success", {"mrr": 1.0}),
    ]
    runs = spark.createDataFrame(rows, "run_id long, dataset_id string, created_at timestamp, status string, scores map<string,double>").withColumn("dataset_name", F.lit("set"))
    best = {(r["run_id"], r["metric"]): r["best"] for r in evaluate.best_prior_scores(runs).collect()}
    assert best == {(2, "mrr"): 0.4, (3, "mrr"): 0.4, (4, "mrr"): 0.4, (5, "mrr"): 0.8, (5, "hit_rate"): 0.5}
    delta = {(r["run_id"], r["metric"]): (r["score"], r["best"]) for r in evaluate.score_delta(runs).collect()}
    assert delta[(5, "mrr")] == (0.0, 0.8) and delta[(1, "mrr")] == (0.4, 0.4) and delta[(3, "hit_rate")] == (0.5, 0.5)
    names = {r["run_id"]: r["name"] for r in evaluate.run_numbers(runs).collect()}
    assert (names[1], names[4], names[6]) == ("set #1", "set #4", "set #1")
    latest = {(r["dataset_id"], r["metric"]): r["score"] for r in evaluate.latest_scores(runs).collect()}
    assert latest[("d", "mrr")] == 0.8 and latest[("d", "hit_rate")] == 0.6


def test_slots(spark):
    rows = [("d", "f1", 10, {"simple": 0, "reasoning": 70, "conditional": 30}), ("d", "f2", 4, {"simple": 0})]
    files = spark.createDataFrame(rows, "dataset_id string, file string, n int, mix map<string,int>")
    got = evalset.category_slots(files)
    assert got.where("file = 'f1'").count() == 10
    assert {r["category"] for r in got.where("file = 'f1'").collect()} <= {"reasoning", "conditional"}
    assert [r["category"] for r in got.where("file = 'f2'").collect()] == ["simple"] * 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evalset.category_slots(files).collect()))
    many = spark.range(2000).select(F.lit("d").alias("dataset_id"), F.col("id").cast("string").alias("file"), F.lit(5).alias("n"), F.create_map(F.lit("reasoning"), F.lit(70), F.lit("simple"), F.lit(30)).alias("mix"))
    assert evalset.category_slots(many).where("category = 'reasoning'").count() / 10000 == pytest.approx(0.7, abs=0.03)


def test_mix_rules(spark):
    rows = [("a", "ok-name", 5, {"simple": 100}), ("b", "ok", 5, {"simple": 90}), ("c", "ok", 11, {"simple": 100}), ("d", "Bad Name", 1, {"simple": 100}), ("e", "ok", 1, {"weird": 100})]
    sets = spark.createDataFrame(rows, "dataset_id string, name string, sample_per_file int, mix map<string,int>")
    assert {r["dataset_id"]: r["reason"] for r in evalset.mix_violations(sets).collect()} == {
        "b": "mix adds up to 90", "c": "samples per file", "d": "name", "e": "unknown category"}


def test_whole_run(spark):
    text = "Refunds take 30 days. Contact billing. " * 3
    documents = spark.createDataFrame([("kb", 1, "faq.md", text), ("kb", 2, "else.md", "Unrelated words on gardens.")], "kb_id string, doc_id long, source string, text string")
    pairs = spark.createDataFrame([(0, "kb", "how long do refunds take", GOLD, "faq.md", "simple", ["money"])], "query_id long, kb_id string, text string, context string, source_file string, category string, labels array<string>")
    base = KbConfig(chunking_method="fix-sized")
    result = run_experiment(pairs, build_corpus(documents, base), base, metrics=["mrr", "context_recall"])
    assert scores_map(result.scores).head()["scores"] == {"mrr": 1.0, "context_recall": 1.0}
    (doc,) = result.documents.collect()
    assert doc["status"] == "full" and doc["retrieved"][0]["source"] == "faq.md" and len(doc["retrieved"][0]["highlights"]) == 2
    with pytest.raises(ValueError):
        run_experiment(pairs, None, base, metrics=["speed"])
