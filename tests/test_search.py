from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tidemark.bindings.retrieval import Q, _vectors
from tidemark.bindings.tables import embed_hashed, queries
from tidemark.bindings.tables import corpus as given_corpus
from tidemark.config import KbConfig, SearchConfig
from tidemark.functions import text as X
from tidemark.operators import catalog, index, nearest, postings, search
from tidemark.plans.corpus import build_corpus
from tidemark.plans.retrieval import retrieve

BOTH = KbConfig(indexes=("bm25", "axis"), hyde_model_id="w")
AXES = ("coins", "victor", "winner", "pelicans")


def axis(df):
    text = next(c for c in ("content", "text") if c in df.columns)
    flags = F.array(*(F.contains(F.lower(text), F.lit(a)).cast("float") for a in AXES))
    return df.withColumn("embedding", flags)


def docs(spark, *texts, kb="kb"):
    return spark.createDataFrame([(kb, i, f"{i}.txt", t) for i, t in enumerate(texts)], "kb_id string, doc_id long, source string, text string")


def asked(spark, *texts, kb="kb"):
    return spark.createDataFrame([(i, kb, t) for i, t in enumerate(texts)], "query_id long, kb_id string, text string")


def sources(hits):
    return [r["source"] for r in hits.orderBy("query_id", "rank").collect()]


def embed_queries(df):
    return axis(df).select("query_id", "kb_id", "embedding")


def test_best_match_first(spark):
    built = build_corpus(docs(spark, "gardening tips for tomatoes", "engines store sparse vectors"))
    assert sources(retrieve(asked(spark, "sparse vectors"), built)) == ["1.txt"]
    assert retrieve(asked(spark, "seabirds"), built).count() == 0


def test_fusion_finds_what_one_index_misses(spark):
    built = build_corpus(docs(spark, "the prize of kings", "a victor stands"), BOTH, {"axis": axis})
    question = asked(spark, "prize victors")
    assert sources(retrieve(question, built, BOTH)) == ["0.txt"]
    both = retrieve(question, built, BOTH, SearchConfig(indexes=("bm25", "axis")), {"axis": embed_queries})
    assert sorted(sources(both)) == ["0.txt", "1.txt"]


def test_hyde_searches_by_the_passage(spark):
    built = build_corpus(docs(spark, "pelicans fish at dawn"), BOTH, {"axis": axis})
    passage = asked(spark, "pelicans").select("query_id", "text")
    found = retrieve(asked(spark, "seabirds"), built, BOTH, SearchConfig(hyde=True), hypotheses=passage)
    assert sources(found) == ["0.txt"]


def test_rerank_flips_order(spark):
    built = build_corpus(docs(spark, "coins coins coins", "coins winner winner"))
    base = KbConfig(reranker_type="cross-encoder", reranker_model_id="m")
    count = lambda q, t: F.size(F.split(t, "winner")).cast("double") - 1
    found = retrieve(
        asked(spark, "coins"), built, base, SearchConfig(rerank_on="parent"),
        rerank=lambda hits, q: search.rerank(hits, q, "parent", count),
    )
    assert [(r["source"], r["score"]) for r in found.orderBy("rank").collect()] == [("1.txt", 2.0), ("0.txt", 0.0)]


def test_other_bases_are_not_searched(spark):
    built = build_corpus(docs(spark, "coins here").unionByName(docs(spark, "coins there", kb="other")))
    hits = retrieve(asked(spark, "coins", kb="other"), built).collect()
    assert [r["content"] for r in hits] == ["coins there"]


def test_maxsim_scores(spark):
    def unit(*names):
        return [[1.0 if a == n else 0.0 for a in ("coins", "win")] for n in names]

    hits = spark.createDataFrame(
        [(0, 1, "kb", "unknown", "u", 3.0), (0, 2, "kb", "both", "b", 2.0), (0, 3, "kb", "coins", "c", 1.0)],
        "query_id long, rank int, kb_id string, parent_id string, child_id string, score double",
    )
    tokens = spark.createDataFrame([("kb", "both", unit("coins", "win")), ("kb", "coins", unit("coins", "coins"))], "kb_id string, chunk_id string, vectors array<array<float>>")
    question = spark.createDataFrame([(0, unit("coins", "win"))], "query_id long, vectors array<array<float>>")
    got = search.maxsim_rerank(hits, question, tokens, "parent").orderBy("rank").collect()
    assert [(r["parent_id"], r["score"]) for r in got] == [("both", 2.0), ("coins", 1.0), ("unknown", 0.0)]


def token_axes(df):
    """A unit vector per known word; `victor` and `winner` mean the same."""
    text = next(c for c in ("content", "text") if c in df.columns)
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin("coins", "victor", "winner"))
    axis_of = lambda w: F.array(*(F.when(c, 1.0).otherwise(0.0).cast("float") for c in (w == "coins", w != "coins")))
    return df.withColumn("embedding", F.transform(words, axis_of))


@pytest.mark.parametrize("on, scores", [("parent", [("0.txt", 2.0), ("1.txt", 1.0)]), ("child", [("1.txt", 1.0), ("0.txt", 1.0)])])
def test_late_interaction_on_parent_or_child(spark, on, scores):
    long = "victor " + "filler words go on and on " * 30 + " coins at last"
    base = KbConfig(reranker_type="late-interaction", reranker_model_id="late")
    built = build_corpus(docs(spark, long, "coins coins coins"), base, {"late": token_axes})
    assert built.tokens.where("is_parent").count() == 2
    config = SearchConfig(rerank_on=on)
    found = retrieve(asked(spark, "coins winner"), built, base, config, {"late": token_axes})
    assert [(r["source"], r["score"]) for r in found.orderBy("rank").collect()] == scores


def test_orphan_hit_keeps_child_text(spark):
    built = build_corpus(docs(spark, "parent text", "orphan text"))
    hits = search.sparse_search(asked(spark, "parent orphan text"), built.terms, built.idf, 5, per_parent=True)
    full = search.hydrate(hits, built.parents.where("source = '0.txt'"), built.children)
    assert set(search.context_passages(full).head()["passages"].split("\n\n")) == {"parent text", "orphan text"}


def brute_bm25(built, question):
    idf = {r["term"]: r["idf"] for r in built.idf.collect()}
    weigh = index.weighted_terms(X.tokenize(F.col("text")))
    scores = {}
    held = [(r["parent_id"], r["child_id"], dict(zip(r["terms"], r["weights"]))) for r in built.terms.collect()]
    for q in question.select("query_id", weigh.alias("w")).collect():
        for parent, child, weights in held:
            s = sum(w["weight"] * idf[w["term"]] * weights[w["term"]] for w in q["w"] if w["term"] in weights)
            if s > 0:
                scores.setdefault(q["query_id"], []).append((-round(s, 9), child, parent))
    return scores


@pytest.mark.parametrize("per_parent", [False, True])
def test_sparse_search_equals_brute_force(spark, sf, monkeypatch, per_parent):
    built, question = given_corpus(spark, sf), queries(spark, sf)
    expected = []
    for query, rows in brute_bm25(built, question).items():
        best = {}
        for score, child, parent in sorted(rows):
            best.setdefault(parent if per_parent else child, (score, child))
        expected += [(query, n, c, -s) for n, (s, c) in enumerate(sorted(best.values())[:7], 1)]

    def run():
        found = search.sparse_search(question, built.terms, built.idf, 7, per_parent).collect()
        return sorted((r["query_id"], r["rank"], r["child_id"], r["score"]) for r in found)

    whole = run()
    assert [r[:3] for r in whole] == [r[:3] for r in sorted(expected)]
    assert [r[3] for r in whole] == pytest.approx([r[3] for r in sorted(expected)], abs=2e-6)
    monkeypatch.setattr(search, "SCORE_CELLS", 500)
    assert run() == whole
    monkeypatch.setattr(search, "SHIPPED_QUERIES", 9)  # the join instead
    joined = run()
    assert [r[:3] for r in joined] == [r[:3] for r in whole]
    assert [r[3] for r in joined] == pytest.approx([r[3] for r in whole])


@pytest.mark.parametrize("per_parent, limit", [(False, 7), (True, 3), (False, 5000)])
def test_pruned_search_equals_a_scan(spark, sf, tmp_path, per_parent, limit):
    built, question = given_corpus(spark, sf), queries(spark, sf)
    postings.save(postings.cluster(built.terms), str(tmp_path))
    blocks = postings.read(spark, str(tmp_path))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["child_id"], round(r["score"], 6)) for r in df.collect())
    assert rows(postings.search(question, blocks, built.idf, limit, per_parent)) == rows(search.sparse_search(question, built.terms, built.idf, limit, per_parent))


def test_asked_terms_are_all_that_is_read(spark, sf, tmp_path):
    """Files opened and rows scanned follow the terms of the question, not the index."""
    built = given_corpus(spark, sf)
    postings.save(postings.cluster(built.terms), str(tmp_path))
    blocks = postings.read(spark, str(tmp_path))
    terms = built.idf.orderBy(F.desc("df"), "term").limit(4).select("kb_id", "term")
    read = postings.named(blocks, terms)
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan and "In(term" in plan
    assert {r["term"] for r in read.select("term").distinct().collect()} == {r["term"] for r in terms.collect()}
    assert read.select("folder").distinct().count() <= 4 < blocks.select("folder").distinct().count()


def test_weak_blocks_are_left_closed(spark):
    """A rare term decides; of a term that all children hold only the children found are looked up."""
    texts = [f"common words {'rare' if i % 500 == 0 else ''} filler{i}" for i in range(2000)]
    built = build_corpus(docs(spark, *texts))
    blocks = postings.cluster(built.terms)
    question = asked(spark, "rare common")
    found = postings.search(question, blocks, built.idf, 3)
    expected = search.sparse_search(question, built.terms, built.idf, 3)
    assert [r["child_id"] for r in found.orderBy("rank").collect()] == [r["child_id"] for r in expected.orderBy("rank").collect()]
    held = {r["term"]: r["n"] for r in blocks.groupBy("term").agg(F.sum(F.size("held")).alias("n")).collect()}
    assert held["common"] == 2000 and held["rare"] == 4
    assert blocks.where("term = 'common'").count() >= 4 and blocks.agg(F.max(F.size("held"))).head()[0] < 2 * postings.BLOCK


def test_only_asked_indexes_are_built(spark, monkeypatch):
    """A sparse search makes no vectors, one file's chunks need no index of all files."""
    from tidemark.bindings import catalog as files
    from tidemark.bindings import tables

    def never(*_, **__):
        raise AssertionError("built")

    monkeypatch.setattr(tables, "_built", {})
    monkeypatch.setattr(tables, "_chunked", {})
    monkeypatch.setattr(tables, "embed_hashed", never)
    assert Q["bm25_search"](spark, "/root/testdata/sf0.001").count() > 0
    tables._built.clear()
    monkeypatch.setattr(tables, "build_corpus", never)
    assert Q["delete_node_rows"](spark, "/root/testdata/sf0.001").count() > 0
    monkeypatch.setattr(tables, "materialize", never)
    assert files.Q["file_chunks"](spark, "/root/testdata/sf0.001").count() > 0


def test_unanswerable_queries_need_no_pairs(spark, monkeypatch):
    """As an empty search says, without scoring any child."""
    built = build_corpus(docs(spark, "coin medal", "coin coin", "badge"))
    question = spark.createDataFrame([(1, "kb", "gold coin"), (2, "kb", "silver"), (3, "none", "coin"), (4, "kb", None), (5, "kb", "...")], "query_id long, kb_id string, text string")
    question = question.withColumn("kb_id", F.when(F.col("kb_id") == "kb", F.lit(built.children.head()["kb_id"])).otherwise(F.col("kb_id")))
    empty = {r["query_id"] for r in search.empty_queries(question, search.sparse_search(question, built.terms, built.idf, 1)).collect()}
    monkeypatch.setattr(search, "sparse_search", None)
    assert {r["query_id"] for r in search.unanswerable(question, built.idf).collect()} == empty == {2, 3, 4, 5}
    given = Q["empty_queries"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "child_id" not in given.split("== Physical Plan ==")[1]


def test_many_queries_stay_on_the_executors(spark, sf, monkeypatch):
    built, question = given_corpus(spark, sf), queries(spark, sf)
    monkeypatch.setattr(search, "SHIPPED_QUERIES", 1)
    monkeypatch.setattr(search, "TILE", 16)

    def never(*_):
        raise AssertionError("fetched")

    monkeypatch.setattr(type(question), "toPandas", never)
    monkeypatch.setattr(type(question), "toArrow", never)
    search.sparse_search(question, built.terms, built.idf, 7).write.format("noop").mode("overwrite").save()
    found = search.dense_search(embed_hashed(question), built.dense["hashed"], 5)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_dense_blocks_agree(spark, sf, monkeypatch):
    built, question = given_corpus(spark, sf), embed_hashed(queries(spark, sf))
    run = lambda: search.dense_search(question, built.dense["hashed"], 5, True).orderBy("query_id", "rank").collect()
    whole = run()
    monkeypatch.setattr(search, "SCORE_CELLS", 400)
    assert run() == whole
    monkeypatch.setattr(search, "TILE", 16)
    assert run() == whole


def pairs(found):
    return {(r["query_id"], r["child_id"]) for r in found.collect()}


@pytest.mark.parametrize("tile", [nearest.TILE, 30])
def test_lists_find_clustered_neighbours(spark, monkeypatch, tmp_path, tile):
    """Two bases, hot lists split into tiles, repeated and empty vectors, an index opened again from disk."""
    monkeypatch.setattr(nearest, "TILE", tile)
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((20, 16))
    points = [(i, (centers[i % 20 if i % 3 else 0] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(600)]
    rows = [("kb" if i % 5 else "other", i // 2, i, v) for i, v in points] + [("kb", 900, 900, None), ("kb", 901, 901, []), ("kb", 902, 902, points[1][1])]
    held = spark.createDataFrame(rows, "kb_id string, parent_id long, child_id long, embedding array<float>")
    question = spark.createDataFrame([(i, "kb" if i % 5 else "other", v) for i, v in points[:60]] + [(999, "none", points[0][1])], "query_id long, kb_id string, embedding array<float>")
    nearest.build(held).save(str(tmp_path / "lists"))
    lists = nearest.open_lists(spark, str(tmp_path / "lists"))
    assert lists.vectors.count() == 601 and lists.centroids.agg(F.max("probes")).head()[0] < 12
    counted = spark.sparkContext.accumulator(0)
    exact, near = pairs(search.dense_search(question, held.where("size(embedding) > 0"), 5)), pairs(nearest.search(question, lists, 5, counted=counted))
    assert len(exact & near) / len(exact) > 0.95 and counted.value < 60 * 601 / 3
    full = {(r["query_id"], r["child_id"]): r["score"] for r in search.dense_search(question, held.where("size(embedding) > 0"), 50).collect()}
    scores = [(r["score"], full[r["query_id"], r["child_id"]]) for r in nearest.search(question, lists, 5).collect() if (r["query_id"], r["child_id"]) in full]
    assert scores and all(a == pytest.approx(b, abs=1e-6) for a, b in scores)
    parents = nearest.search(question, lists, 3, per_parent=True).collect()
    assert all(n == 1 for n in Counter((r["query_id"], r["parent_id"]) for r in parents).values())


@pytest.mark.parametrize("tile, per_parent", [(nearest.TILE, False), (40, True)])
def test_bounds_skip_lists_and_lose_nothing(spark, monkeypatch, tile, per_parent):
    """Clusters far apart: results as of an exact search, with a small part of its dot products."""
    monkeypatch.setattr(nearest, "TILE", tile)
    rng = np.random.default_rng(12)
    centers = rng.standard_normal((30, 12))
    points = [(i, (centers[i % 30] + 0.05 * rng.standard_normal(12)).tolist()) for i in range(900)]
    held = spark.createDataFrame([("kb", i // 3, i, v) for i, v in points], "kb_id string, parent_id long, child_id long, embedding array<float>")
    question = spark.createDataFrame([(i, "kb", v) for i, v in points[:90]] + [(900, "kb", rng.standard_normal(12).tolist())], "query_id long, kb_id string, embedding array<float>")
    counted = spark.sparkContext.accumulator(0)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["child_id"], round(r["score"], 6)) for r in df.collect())
    found = rows(nearest.exact(question, nearest.build(held), 7, per_parent, counted))
    assert counted.value < 91 * 900 / 3
    assert found == rows(search.dense_search(question, held, 7, per_parent))
    assert rows(nearest.exact(question, nearest.build(held.where("child_id < 5")), 7, per_parent)) == rows(search.dense_search(question, held.where("child_id < 5"), 7, per_parent))


def test_a_query_is_sent_once_per_part_not_per_list(spark, sf, monkeypatch):
    """Nothing that is written or met grows with queries times lists."""
    written = {}
    keep = nearest.materialize

    def kept(df, name):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(nearest, "materialize", kept)
    asked, held = _vectors(spark, sf)
    found = nearest.exact(asked, nearest.build(held), 5)
    assert written["probes"].count() == asked.count() and written["centroids"].count() > 5
    assert written["probes"].agg(F.max(F.size("lists"))).head()[0] > 5
    rows = lambda df: sorted((r["query_id"], r["rank"], r["child_id"], r["score"]) for r in df.collect())
    assert rows(found) == rows(search.dense_search(asked, held, 5))


@pytest.mark.parametrize("table", ["", "/root/testdata/sf0.1"])
def test_approximate_recall_of_the_table(spark, sf, table):
    """Over all neighbours, and over those that are not the query itself, with under a third of the dot products."""
    asked, held = _vectors(spark, table or sf)
    lists, counted = nearest.build(held), spark.sparkContext.accumulator(0)
    exact, near = pairs(search.dense_search(asked, held, 5)), pairs(nearest.search(asked, lists, 5, counted=counted))
    others = {(q, c) for q, c in exact if q != c}
    assert len(exact & near) >= 0.9 * len(exact) and len(others & near) >= 0.9 * len(others)
    n = held.count()
    print(n, len(others & near) / len(others), (counted.value + 2 * n * lists.centroids.count()) / n / n)
    assert counted.value + 2 * n * lists.centroids.count() < n * n / 3


def test_a_joined_side_is_shuffled_once(spark):
    """No side is copied per salt, and none is run only to be measured."""
    left = spark.range(100_000).select("id", (F.col("id") % 7).alias("model_id"))
    right = spark.range(50_000).select(F.col("id").alias("model_id"), F.lit("m").alias("name"))
    plan = catalog.null_dangling(left, "model_id", right)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "Generate" not in physical and physical.count("Exchange hashpartitioning") <= 2


def test_idf_is_rarity(spark):
    built = build_corpus(docs(spark, "coin coin", "coin", "medal"))
    idf = {r["term"]: r for r in built.idf.collect()}
    assert idf["coin"]["df"] == 2 and idf["coin"]["n_children"] == 3
    assert idf["medal"]["idf"] == pytest.approx(np.log(1 + 2.5 / 1.5))
    assert index.delete_nodes(built.terms.withColumnRenamed("doc_id", "node_id"), spark.createDataFrame([(0,)], "node_id long")).count() == 2


@pytest.mark.parametrize("bad", [
    dict(chunking_method="magic"), dict(max_chunk_size=0), dict(min_chunk_size=0), dict(indexes=()),
    dict(min_chunk_size=500, max_chunk_size=500), dict(chunking_method="semantic"),
    dict(reranker_type="cross-encoder"), dict(reranker_type="other", reranker_model_id="m"), dict(indexes=("",)),
])
def test_refused_base_configs(bad):
    with pytest.raises(ValueError):
        KbConfig(**bad)


def test_refused_searches():
    for bad in (dict(top_k=0), dict(indexes=()), dict(prefetch_limit=-1), dict(rerank_on="page")):
        with pytest.raises(ValueError):
            SearchConfig(**bad)
    for config in (SearchConfig(indexes=("m",)), SearchConfig(rerank_on="child"), SearchConfig(hyde=True)):
        with pytest.raises(ValueError):
            config.check_against(KbConfig())
    assert (SearchConfig(top_k=7).pool, SearchConfig(top_k=7).prefetch) == (7, 14)


def test_blocks_are_made_and_searched_within_segments(spark, sf, monkeypatch):
    """No row per child and term is shuffled for blocks, and ids are stored once a child; scores are the scan's."""
    built, question = given_corpus(spark, sf), queries(spark, sf)
    assert "Exchange" not in postings.cluster(built.terms)._jdf.queryExecution().toString()
    rows = lambda df: sorted((r["query_id"], r["rank"], r["child_id"], round(r["score"], 6)) for r in df.collect())
    expected = rows(search.sparse_search(question, built.terms, built.idf, 5))
    monkeypatch.setattr(postings, "SEGMENT", 100)
    monkeypatch.setattr(postings, "SHIPPED_QUERIES", 9)
    blocks = postings.cluster(built.terms)
    lists = blocks.where("term IS NULL").select("segment", F.size("children").alias("n")).collect()
    assert len({r["segment"] for r in lists}) == len(lists) and max(r["n"] for r in lists) == 100
    assert sum(r["n"] for r in lists) == built.children.count()
    assert rows(postings.search(question, blocks, built.idf, 5)) == expected


def test_tiles_give_up_a_few_rows_per_query(spark, monkeypatch):
    """Many queries: what is handed on does not grow with small tiles, nor with equal vectors and equal scores."""
    rng = np.random.default_rng(5)
    points = [[0.0] * 8 if i % 9 == 0 else [1.0] * 8 if i % 3 == 0 else rng.integers(-2, 3, 8).astype(float).tolist() for i in range(600)]
    held = spark.createDataFrame([("kb", i // 4, i, v) for i, v in enumerate(points)], "kb_id string, parent_id long, child_id long, embedding array<float>")
    asked = held.select(F.col("child_id").alias("query_id"), "kb_id", "embedding")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["child_id"], round(r["score"], 6)) for r in df.collect())
    whole = [rows(search.dense_search(asked, held, 5, per_parent)) for per_parent in (False, True)]
    given, ranked = [], search._ranked
    monkeypatch.setattr(search, "_ranked", lambda found, *more: given.append(found.count()) or ranked(found, *more))
    monkeypatch.setattr(search, "TILE", 16)
    assert [rows(search.dense_search(asked, held, 5, per_parent)) for per_parent in (False, True)] == whole
    most = np.ceil((search.GROUPS_PER_CORE * spark.sparkContext.defaultParallelism) ** 0.5)
    assert all(n <= 600 * 5 * most for n in given)


@pytest.mark.parametrize("group", ["child_id", "parent_id"])
def test_best_of_blocks_is_exact(group):
    """Any blocks of scores in single precision, ties and repeated vectors: the best by double precision."""
    rng = np.random.default_rng(8)
    vectors = search._unit(np.repeat(rng.standard_normal((150, 6)), 2, axis=0) + 1e-7 * rng.standard_normal((300, 6)))
    vectors[40:80] = vectors[0]
    rows = pa.table({"kb_id": ["kb"] * 300, "parent_id": pa.array(np.arange(300) // 7), "child_id": [f"{i:03}" for i in range(300)], "embedding": list(vectors)})
    asked = pa.table({"query_id": np.arange(60), "embedding": list(vectors[:60])})
    best = search.Best(search._matrix(asked["embedding"]), rows, group, 5)
    for some in search._blocks(best.group, 37, best.distinct()):
        for start in (0, 25, 50):
            asking = np.arange(start, min(start + 25, 60))
            best.look(asking, some, (best.queries[asking] @ best.vectors[some].T).astype(np.float32))
    found = best.found(asked, rows)
    exact = np.round(best.queries @ best.vectors.T, search.PLACES)
    for q in range(60):
        order, seen = sorted(range(300), key=lambda i: (-exact[q, i], i)), []
        for i in order:
            if best.group[i] not in [best.group[j] for j in seen]:
                seen.append(i)
        mine = found.filter(pa.compute.equal(found["query_id"], q))
        assert sorted(mine["child_id"].to_pylist()) == sorted(f"{i:03}" for i in seen[:5])


def test_few_lists_are_looked_into_for_a_bound(spark, sf, monkeypatch):
    """An exact search needs no whole approximate one before it."""
    asked, held = _vectors(spark, sf)
    lists, counted = nearest.build(held), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(nearest, "search", None)
    found = nearest.exact(asked, lists, 5, counted=counted)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["child_id"], r["score"]) for r in df.collect())
    assert rows(found) == rows(search.dense_search(asked, held, 5))
    assert counted.value > 0


def test_sketches_compared_as_products(monkeypatch):
    """Two rows share a number, and the order of differing bits comes out exactly."""
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, (31, nearest.BITS // 64)).astype(np.uint64)
    asked = np.r_[codes[:4], np.zeros((1, codes.shape[1]), np.uint64), ~codes[5:6], ~np.zeros((1, codes.shape[1]), np.uint64)]
    alike = nearest._alike(2 * nearest._bits(asked) - 1, nearest._sides(codes), len(codes))
    apart = np.bitwise_count(asked[:, None] ^ codes[None]).sum(axis=2)
    set_bits = np.bitwise_count(asked).sum(axis=1)
    assert (alike == set_bits[:, None].astype(int) - apart).all()


def test_many_vectors_keep_all_cores_busy(spark):
    """Parts and tiles of an index follow the number of cores, not a fixed size alone."""
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([("kb", i, i, v) for i, v in enumerate(rng.standard_normal((18_000, 4)).tolist())], "kb_id string, parent_id long, child_id long, embedding array<float>")
    parts = nearest._parted(nearest.build(vectors).centroids).agg(F.count_distinct("part")).head()[0]
    assert parts >= 3
