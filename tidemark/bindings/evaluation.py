"""Evaluation of benchmark passages, runs and evaluation sets over the given tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidemark.bindings import sql
from tidemark.bindings.tables import BASE, FIXED_CONFIG, SPARSE, corpus, load
from tidemark.config import CATEGORIES, METRICS
from tidemark.functions.text import normalize_for_match, split_sentences
from tidemark.operators import evalset, evaluate
from tidemark.plans.retrieval import retrieve
from tidemark.plans.skew import materialize, spread

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def register(run):
        Q[name] = run
        if oracle:
            O[name] = oracle
        return run

    return register


_held: dict[tuple[str, str, str], object] = {}


def _once(spark, sf, name, make):
    key = (spark.sparkContext.applicationId, os.path.abspath(sf), name)
    if key not in _held:
        _held[key] = materialize(make(), name)
    return _held[key]


# A pair per passage. Its source is the document with the most of its sentences, the question
# is every second word of it.
_PAIRS = f"""
doc_sentences AS (SELECT DISTINCT doc_id, {sql.match_key('s')} AS k FROM (SELECT doc_id, unnest({sql.sentences('text')}) AS s FROM documents)),
item_sentences AS (SELECT DISTINCT item_id, {sql.match_key('s')} AS k FROM (SELECT item_id, unnest({sql.sentences('text')}) AS s FROM benchmark)),
shared AS (SELECT item_id, doc_id, count(*) AS n FROM item_sentences JOIN doc_sentences USING (k) GROUP BY ALL),
origins AS (SELECT item_id, doc_id FROM shared QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) = 1),
tags AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS labels FROM labels),
pairs AS (SELECT b.item_id AS query_id, b.text AS context, o.doc_id::VARCHAR AS source_file,
  (['simple', 'reasoning', 'multi_context', 'conditional'])[b.item_id % 4 + 1] AS category,
  coalesce(t.labels, []) AS labels, array_to_string(list_filter(string_split(b.text, ' '), lambda w, i: i % 2 = 1), ' ') AS text
  FROM benchmark b LEFT JOIN origins o USING (item_id) LEFT JOIN tags t ON t.doc_id = o.doc_id)"""


def pairs(spark, sf):
    def make():
        def keys(table, key):
            sentence = F.explode(split_sentences(F.col("text"))).alias("_s")
            return load(spark, sf, table).select(key, sentence).select(
                key, normalize_for_match(F.col("_s")).alias("k")
            ).distinct()

        documents = spread(load(spark, sf, "documents"), "doc_id")
        said = documents.select("doc_id", F.explode(split_sentences(F.col("text"))).alias("_s")).select(
            "doc_id", normalize_for_match(F.col("_s")).alias("k")
        ).distinct()
        shared = said.join(keys("benchmark", "item_id"), "k").groupBy("item_id", "doc_id").agg(
            F.count("*").alias("n")
        )
        origins = shared.groupBy("item_id").agg(
            F.min(F.struct((-F.col("n")).alias("n"), "doc_id"))["doc_id"].alias("doc_id")
        )
        tag = lambda c: F.when(F.col(c) == 1, c)
        tags = load(spark, sf, "labels").select(
            "doc_id", F.filter(F.array(tag("quality"), tag("toxic")), lambda x: x.isNotNull()).alias("labels")
        )
        category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("item_id") % 4 + 1).cast("int"))
        words = F.filter(F.split("text", " "), lambda w, i: i % 2 == 0)
        return (
            load(spark, sf, "benchmark").join(origins, "item_id", "left").join(tags, "doc_id", "left").select(
                F.col("item_id").alias("query_id"), F.lit(BASE).alias("kb_id"), F.array_join(words, " ").alias("text"),
                F.col("text").alias("context"), F.col("doc_id").cast("string").alias("source_file"),
                category.alias("category"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
            )
        )

    return _once(spark, sf, "pairs", make)


def hits(spark, sf):
    asked = pairs(spark, sf).select("query_id", "kb_id", "text")
    return _once(spark, sf, "eval_hits", lambda: retrieve(asked, corpus(spark, sf, SPARSE), FIXED_CONFIG))


def judged(spark, sf):
    return evaluate.judge(hits(spark, sf), pairs(spark, sf))


def scores(spark, sf):
    return evaluate.pair_scores(judged(spark, sf), pairs(spark, sf))


_ASKED = "asked AS (SELECT query_id, 'main' AS kb_id, text FROM pairs)"
_JUDGED = f"""WITH {sql.PARENTS}, {sql.CHILDREN}, {sql.POSTINGS}, {_PAIRS}, {_ASKED}, {sql.sparse('asked')},
hits AS (SELECT h.*, p.content, p.source FROM ({sql.collapsed('sparse', 5)}) h JOIN parents p USING (parent_id)),
gold AS (SELECT query_id, source_file, i - 1 AS gold, {sql.match_key('g[i]')} AS sentence FROM (
  SELECT query_id, source_file, g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT query_id, source_file, {sql.sentences('context')} AS g FROM pairs))),
matches AS (SELECT h.query_id, h.rank, h.parent_id, h.content, g.gold, g.sentence,
    instr({sql.match_key('h.content')}, g.sentence) AS found_at
  FROM hits h JOIN gold g ON g.query_id = h.query_id AND g.source_file = h.source
  WHERE instr({sql.match_key('h.content')}, g.sentence) > 0),
places AS (SELECT *, list_filter(range(0, length(content)), lambda i: NOT regexp_matches(substring(content, i + 1, 1), '\\s')) AS raw FROM matches),
spans AS (SELECT query_id, rank, parent_id, gold, raw[found_at] AS start, raw[found_at + length(sentence) - 1] + 1 AS "end" FROM places),
per_query AS (SELECT h.query_id, avg((m.query_id IS NOT NULL)::INTEGER) AS prec, min(CASE WHEN m.query_id IS NOT NULL THEN h.rank END) AS first
  FROM hits h LEFT JOIN (SELECT DISTINCT query_id, rank FROM matches) m ON m.query_id = h.query_id AND m.rank = h.rank GROUP BY h.query_id),
covered AS (SELECT query_id, count(DISTINCT gold) AS n FROM matches GROUP BY query_id),
scores AS (SELECT p.query_id, p.category, p.labels, coalesce(q.prec, 0) AS context_precision,
    CASE WHEN g.n > 0 THEN coalesce(c.n, 0) / g.n ELSE 0 END AS context_recall, (q.first IS NOT NULL)::INTEGER::DOUBLE AS hit_rate,
    coalesce(1e0 / q.first, 0) AS mrr,
    CASE WHEN g.n > 0 AND c.n = g.n THEN 'full' WHEN c.n > 0 THEN 'partial' ELSE 'miss' END AS status
  FROM pairs p LEFT JOIN per_query q USING (query_id) LEFT JOIN covered c USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id) g USING (query_id))"""


@query("gold_matches", f"{_JUDGED} SELECT query_id, rank, parent_id, gold FROM matches")
def gold_matches(spark, sf):
    return evaluate.gold_matches(judged(spark, sf)).select(
        "query_id", F.col("rank").cast("long"), "parent_id", F.col("gold").cast("long")
    )


@query("highlight_spans", f"""{_JUDGED} SELECT query_id, rank, string_agg(start || '-' || "end", ',' ORDER BY start, "end") AS spans FROM spans GROUP BY ALL""")
def highlight_spans(spark, sf):
    span = lambda s: F.concat(s["start"], F.lit("-"), s["end"])
    marked = evaluate.highlights(judged(spark, sf)).where(F.size("highlights") > 0)
    return marked.select(
        "query_id", F.col("rank").cast("long"), F.array_join(F.transform("highlights", span), ",").alias("spans")
    )


_R = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


def _rounded():
    return [F.round(m, 6).alias(m) for m in METRICS]


@query("pair_metrics", f"{_JUDGED} SELECT query_id, {_R} FROM scores")
def pair_metrics(spark, sf):
    return scores(spark, sf).select("query_id", *_rounded())


@query("pair_status", f"{_JUDGED} SELECT query_id, category, status FROM scores")
def pair_status(spark, sf):
    return scores(spark, sf).select("query_id", "category", "status")


@query("pair_filter", f"{_JUDGED} SELECT query_id FROM scores WHERE len(labels) = 0 AND status = 'miss' AND category = 'simple'")
def pair_filter(spark, sf):
    return evaluate.filter_pairs(scores(spark, sf), "simple", evaluate.UNTAGGED, "miss").select("query_id")


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)
_MEAN = "round((" + " + ".join(f"avg({m})" for m in METRICS) + ") / 4, 6) AS score"


@query("run_scores", f"{_JUDGED} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count(*) AS pairs, round(avg({m}), 6) AS score FROM scores" for m in METRICS))
def run_scores(spark, sf):
    return evaluate.run_scores(scores(spark, sf)).select("metric", "pairs", F.round("score", 6).alias("score"))


@query("breakdown_category", f"{_JUDGED} SELECT category, count(*) AS pairs, {_MEANS}, {_MEAN} FROM scores GROUP BY category")
def breakdown_category(spark, sf):
    return evaluate.breakdown_by_category(scores(spark, sf)).select(
        "category", "pairs", *_rounded(), F.round("score", 6).alias("score")
    )


@query("breakdown_label", f"""{_JUDGED} SELECT label, count(*) AS pairs, {_MEANS}, {_MEAN} FROM (
  SELECT *, unnest(CASE WHEN len(labels) = 0 THEN ['untagged'] ELSE list_distinct(labels) END) AS label FROM scores) GROUP BY label""")
def breakdown_label(spark, sf):
    return evaluate.breakdown_by_label(scores(spark, sf)).select(
        "label", "pairs", *_rounded(), F.round("score", 6).alias("score")
    )


@query("nested_result_doc", f"""{_JUDGED}, marked AS (SELECT query_id, rank, string_agg(start || '-' || "end", ',' ORDER BY start, "end") AS spans FROM spans GROUP BY ALL)
SELECT s.query_id, s.status, round(s.mrr, 6) AS mrr, string_agg(concat(h.rank, ':', h.parent_id, ':', h.source, ':', length(h.content), ':', coalesce(m.spans, '')), '|' ORDER BY h.rank) AS retrieved
FROM scores s LEFT JOIN hits h USING (query_id) LEFT JOIN marked m ON m.query_id = h.query_id AND m.rank = h.rank GROUP BY s.query_id, s.status, s.mrr""")
def nested_result_doc(spark, sf):
    docs = evaluate.result_documents(judged(spark, sf), pairs(spark, sf), scores(spark, sf))
    span = lambda s: F.concat(s["start"], F.lit("-"), s["end"])
    line = lambda h: F.concat_ws(
        ":", h["rank"], h["chunk_id"], h["source"], F.length(h["content"]),
        F.array_join(F.transform(h["highlights"], span), ","),
    )
    return docs.select(
        "query_id", "status", F.round("scores.mrr", 6).alias("mrr"),
        F.array_join(F.transform("retrieved", line), "|").alias("retrieved"),
    )


# --- runs: an order is a run of its customer's dataset --------------------------------------

_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS dataset_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  o_totalprice / 500000 AS hit_rate, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 600000 END AS mrr FROM orders),
long AS (SELECT run_id, dataset_id, created_at, status, 'hit_rate' AS metric, hit_rate AS score FROM runs
  UNION ALL SELECT run_id, dataset_id, created_at, status, 'mrr', mrr FROM runs WHERE mrr IS NOT NULL),
board AS (SELECT * FROM long WHERE status = 'success')"""


def runs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    hit = F.col("o_totalprice") / 500000
    mrr = F.col("o_totalprice") / 600000
    both = F.create_map(F.lit("hit_rate"), hit, F.lit("mrr"), mrr)
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset_id"),
        F.concat(F.lit("set-"), "o_custkey").alias("dataset_name"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        status.alias("status"),
        F.when(F.col("o_orderkey") % 3 > 0, both).otherwise(F.create_map(F.lit("hit_rate"), hit)).alias("scores"),
    )


@query("score_board", f"WITH {_RUNS} SELECT dataset_id, run_id, metric, score, epoch_us(created_at) AS made_at FROM board")
def score_board(spark, sf):
    return evaluate.score_board(runs(spark, sf)).select(
        "dataset_id", "run_id", "metric", "score", F.unix_micros("created_at").alias("made_at")
    )


@query("latest_scores", f"""WITH {_RUNS} SELECT dataset_id, metric, score FROM board
QUALIFY row_number() OVER (PARTITION BY dataset_id, metric ORDER BY created_at DESC, run_id DESC) = 1""")
def latest_scores(spark, sf):
    return evaluate.latest_scores(runs(spark, sf))


_BEST = f"""WITH {_RUNS}, best AS (SELECT r.run_id, b.metric, max(b.score) AS best FROM runs r
  JOIN board b ON b.dataset_id = r.dataset_id AND b.created_at < r.created_at GROUP BY ALL)"""


@query("best_prior_scores", f"{_BEST} SELECT run_id, metric, best FROM best")
def best_prior_scores(spark, sf):
    return evaluate.best_prior_scores(runs(spark, sf)).select("run_id", "metric", "best")


@query("score_delta", f"""{_BEST} SELECT run_id, metric, coalesce(l.score, 0) AS score, coalesce(b.best, l.score) AS best,
  coalesce(l.score, 0) - coalesce(b.best, l.score) AS delta FROM long l FULL JOIN best b USING (run_id, metric)""")
def score_delta(spark, sf):
    return evaluate.score_delta(runs(spark, sf))


@query("run_numbers", f"""WITH {_RUNS} SELECT run_id, n AS run_number, 'set-' || dataset_id || ' #' || n AS name FROM (
  SELECT run_id, dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at, run_id) AS n FROM runs)""")
def run_numbers(spark, sf):
    return evaluate.run_numbers(runs(spark, sf)).select("run_id", "run_number", "name")


@query("rerun_reset", f"""WITH {_RUNS} SELECT run_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status,
  CASE WHEN status <> 'failed' THEN hit_rate END AS hit_rate FROM runs""")
def rerun_reset(spark, sf):
    made = runs(spark, sf)
    return evaluate.reset_runs(made, made.where("status = 'failed'")).select(
        "run_id", "status", F.col("scores")["hit_rate"].alias("hit_rate")
    )


# --- evaluation sets: a customer's orders are the files of a dataset ------------------------

_SETS = """sets AS (SELECT c_custkey AS dataset_id, lower(replace(c_mktsegment, '_', '-')) || CASE WHEN c_acctbal < 0 THEN '!' ELSE '' END AS name,
  (c_custkey % 12)::INTEGER AS sample_per_file, (c_nationkey % 5) * 10 AS a, (c_nationkey % 3) * 20 AS b, 100 - (c_nationkey % 5) * 10 - (c_nationkey % 4) * 20 AS c
  FROM customer)"""


def _sets(spark, sf):
    nation = F.col("c_nationkey")
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("dataset_id"),
        F.concat(F.lower(F.replace("c_mktsegment", F.lit("_"), F.lit("-"))), F.when(F.col("c_acctbal") < 0, "!").otherwise("")).alias("name"),
        (F.col("c_custkey") % 12).cast("int").alias("sample_per_file"),
        F.create_map(
            F.lit("simple"), nation % 5 * 10, F.lit("reasoning"), nation % 3 * 20,
            F.lit("conditional"), 100 - nation % 5 * 10 - nation % 4 * 20,
        ).alias("mix"),
    )


def _files(spark, sf):
    return (
        load(spark, sf, "orders").join(_sets(spark, sf), F.col("o_custkey") == F.col("dataset_id"))
        .select("dataset_id", F.col("o_orderkey").alias("file"), F.greatest(F.lit(1), F.least(F.lit(10), "sample_per_file")).alias("n"), "mix")
    )


_SLOTS = f"""WITH {_SETS}, files AS (SELECT dataset_id, o_orderkey AS file, greatest(1, least(10, sample_per_file)) AS n,
  greatest(a, 0) AS a, greatest(b, 0) AS b, greatest(c, 0) AS c FROM orders JOIN sets ON dataset_id = o_custkey),
slots AS (SELECT *, ('0x' || left(md5(concat_ws('|', file, slot, 0)), 8))::UBIGINT % greatest(a + b + c, 1) AS pick FROM (
  SELECT *, unnest(range(1, n + 1)) AS slot FROM files)),
drawn AS (SELECT dataset_id, file, slot, CASE WHEN a + b + c = 0 OR pick < a THEN 'simple' WHEN pick < a + b THEN 'reasoning' ELSE 'conditional' END AS category FROM slots)"""


@query("category_slots", f"{_SLOTS} SELECT dataset_id, file, slot, category FROM drawn")
def category_slots(spark, sf):
    return evalset.category_slots(_files(spark, sf)).withColumn("slot", F.col("slot").cast("long"))


@query("mix_violations", f"""WITH {_SETS} SELECT dataset_id, CASE WHEN a + b + c <> 100 THEN 'mix adds up to ' || (a + b + c)
  WHEN sample_per_file NOT BETWEEN 1 AND 10 THEN 'samples per file' ELSE 'name' END AS reason FROM sets
WHERE a + b + c <> 100 OR sample_per_file NOT BETWEEN 1 AND 10 OR NOT regexp_matches(name, '^[a-z0-9-]+$')""")
def mix_violations(spark, sf):
    return evalset.mix_violations(_sets(spark, sf))


@query("pair_slots", f"""{_SLOTS} SELECT d.dataset_id, d.file, d.slot, d.category,
  array_to_string(list_filter([l_returnflag, l_linestatus], lambda x: x IN ('A', 'N', 'O')), ',') AS labels
FROM lineitem JOIN drawn d ON d.file = l_orderkey AND d.slot = l_linenumber""")
def pair_slots(spark, sf):
    """A line of the order is the sample written for the slot of its number."""
    samples = load(spark, sf, "lineitem").join(load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(
        F.col("o_custkey").alias("dataset_id"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("slot"),
        F.array("l_returnflag", "l_linestatus").alias("labels"), F.array(*map(F.lit, "ANO")).alias("allowed"),
    )
    made = evalset.pair_slots(evalset.category_slots(_files(spark, sf)), samples)
    return made.select("dataset_id", "file", F.col("slot").cast("long"), "category", F.array_join("labels", ",").alias("labels"))


@query("dataset_progress", """SELECT o_custkey AS dataset_id, count(*) AS file_count, count(n) AS parsed_count, coalesce(sum(n), 0)::BIGINT AS pair_count
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def dataset_progress(spark, sf):
    files = load(spark, sf, "orders").select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("file"))
    written = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"))
    return evalset.progress(files, written.join(files, "file"))


@query("dataset_composition", """WITH pairs AS (SELECT o_custkey AS dataset_id, (['simple', 'reasoning', 'multi_context', 'conditional'])[o_orderkey % 3 + 1] AS category,
  CASE WHEN o_orderstatus = 'P' THEN [] ELSE [o_orderpriority] END AS labels FROM orders),
sets AS (SELECT c_custkey AS dataset_id FROM customer)
SELECT dataset_id, 'category' AS kind, name, count(category) AS pairs FROM (SELECT dataset_id, unnest(['simple', 'reasoning', 'multi_context', 'conditional']) AS name FROM sets)
  LEFT JOIN (SELECT dataset_id, category AS name, category FROM pairs) USING (dataset_id, name) GROUP BY ALL
UNION ALL SELECT dataset_id, 'label', name, count(label) FROM (SELECT dataset_id, unnest(['1-URGENT', '2-HIGH']) AS name FROM sets)
  LEFT JOIN (SELECT dataset_id, labels[1] AS name, labels[1] AS label FROM pairs) USING (dataset_id, name) GROUP BY ALL
UNION ALL SELECT dataset_id, 'label', 'untagged', count(*) FROM pairs WHERE len(labels) = 0 GROUP BY ALL""")
def dataset_composition(spark, sf):
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    none = F.array().cast("array<string>")
    made = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset_id"), category.alias("category"),
        F.when(F.col("o_orderstatus") == "P", none).otherwise(F.array("o_orderpriority")).alias("labels"),
    )
    sets = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("dataset_id"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("labels")
    )
    return evaluate.dataset_composition(sets, made)
