"""The pipeline against plain versions of its decisions, each stage on its own input."""

import zlib

import numpy as np

import corpus_pipeline
from tidemark.llm import minhash_dedup
from tidemark.llm.bindings import tokenizer

from . import brute


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, inputs = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.collect())
        out = str(tmp_path / str(number))
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    raw, ruled, single, clean, mixed = inputs

    ids = lambda rows: sorted(r.doc_id for r in rows)
    for r in ruled:
        n, *_, repeated = brute.quality_counts(r.text)
        assert n >= 20 and 100 * repeated <= 30 * n
    assert len(ruled) > 0.7 * len(raw)

    groups = brute.near_duplicates({r.doc_id: r.text for r in ruled}, 80)
    assert ids(single) == sorted(i for i, (_, _, kept) in groups.items() if kept)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {r.doc_id: brute.contamination(r.text, items) for r in single}
    assert ids(clean) == sorted(i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n))

    size = {r.doc_id: len(brute.spaced(r.text)) for r in clean}
    sources = {}
    for r in clean:
        sources[r.source] = sources.get(r.source, 0) + size[r.doc_id]
    for source, target in brute.mix_targets(sources).items():
        taken = sum(size[r.doc_id] for r in mixed if r.source == source)
        assert abs(taken - target) <= max(size[r.doc_id] for r in clean if r.source == source)

    from tokenizers import Tokenizer

    load = Tokenizer.from_file(tokenizer())
    start, rows = 0, sorted(docs.collect(), key=lambda r: r.start)
    text = {r.doc_id: r.text for r in mixed}
    assert [r.doc_id for r in rows] == ids(mixed)
    for r in rows:
        encoded = load.encode(text[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(encoded), zlib.crc32(np.array(encoded, "<u4").tobytes()))
        start += len(encoded)


def test_near_duplicates_from_four_fifths(spark):
    """Pairs of every similarity around 0.80, against brute force."""
    texts = {}
    for k in range(40):
        words = [f"k{k}w{j}" for j in range(104)]  # 100 shingles
        texts[2 * k] = " ".join(words)
        texts[2 * k + 1] = " ".join(words[: 104 - k] + [f"k{k}x{j}" for j in range(k)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {at: {i for i, (_, _, k) in brute.near_duplicates(texts, at).items() if k} for at in (80, 85)}
    assert kept[80] != kept[85] and len(kept[80]) < len(texts)
    assert {r.doc_id for r in minhash_dedup.keep_one(docs, percent=80).collect()} == kept[80]


def test_stages_at_the_edges(spark, sf, edge_docs):
    """Nulls, empty and very long texts, repeated rows, clashing names; and no rows at all."""
    for docs in (edge_docs, edge_docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == docs.columns
            assert (made.count() > 0) == (docs is edge_docs)


def test_bands_follow_the_threshold():
    for percent in (50, 70, 80, 85, 95, 100):
        assert (1 - (percent / 100) ** minhash_dedup.ROWS) ** minhash_dedup.bands_for(percent) < 1e-5
    assert minhash_dedup.bands_for(minhash_dedup.PERCENT) == minhash_dedup.BANDS


def test_run_is_the_stages_in_order(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "decontamination", "mixing", "token files"]
