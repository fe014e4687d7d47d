"""One evaluation run: search every pair's question, score what came back, keep the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import METRICS, KbConfig, SearchConfig
from tidemark.operators import evaluate
from tidemark.plans.corpus import Corpus
from tidemark.plans.retrieval import retrieve
from tidemark.plans.skew import materialize


@dataclass(frozen=True)
class RunResult:
    scores: DataFrame
    pairs: DataFrame
    documents: DataFrame


def run_experiment(
    pairs: DataFrame,
    corpus: Corpus,
    base: KbConfig,
    config: SearchConfig = SearchConfig(),
    metrics: Sequence[str] = METRICS,
    **search,
) -> RunResult:
    """pairs(query_id, kb_id, text, context, source_file, category, labels).

    A run uses all indexes of the base, and HyDE whenever the base has it, whatever `config`
    says about those two; `search` is passed on to retrieve.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown or not metrics:
        raise ValueError(f"choose metrics from {METRICS}, got {list(metrics)}")
    whole = replace(config, indexes=base.indexes, hyde=base.hyde_model_id is not None)
    asked = pairs.select("query_id", "kb_id", "text")
    hits = materialize(retrieve(asked, corpus, base, whole, **search), "run_hits")
    judged = evaluate.judge(hits, pairs)
    per_pair = materialize(evaluate.pair_scores(judged, pairs), "run_scores")
    return RunResult(
        scores=evaluate.run_scores(per_pair, metrics),
        pairs=per_pair,
        documents=evaluate.result_documents(judged, pairs, per_pair),
    )


def scores_map(scores: DataFrame) -> DataFrame:
    """Metric rows as the one map a run's row carries."""
    entries = F.collect_list(F.struct("metric", "score"))
    return scores.agg(F.map_from_entries(entries).alias("scores"))
