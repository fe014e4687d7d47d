"""Operators with exact results, against plain versions, over the given tables and over edge cases."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate, license_scan, line_dedup, minhash_dedup, mixing, quality_rules, token_files, url_filter
from tidemark.llm.bindings import Q, tokenizer

from . import brute

ITEMS = [
    (1, "jumps over the lazy dog and runs into the deep forest where it meets a bear"), (2, "École MIT"), (3, None), (4, ""),
    (5, "bear that sleeps under an old"), (1, "jumps over the lazy dog and runs into the deep forest where it meets a bear"), (None, "one"),
    (6, "words that stand in no document at all, however long one may look for them in there"),
]


def empty(docs):
    return docs.where("false")


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows if r[key] is not None}


# --- near duplicates ---


def test_near_duplicates_of_the_table(spark, sf, plain_texts):
    got = by_id(Q["op3_minhash_dedup"](spark, sf).collect())
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == brute.near_duplicates(plain_texts)


def test_near_duplicates_at_the_edges(edge_docs, edge_texts):
    rows = minhash_dedup.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in by_id(rows, "id").items()} == brute.near_duplicates(edge_texts)
    assert all(r.kept and r.component_id is None for r in rows if r.id is None)


def test_one_of_each_group_stays(edge_docs, edge_texts):
    left = minhash_dedup.keep_one(edge_docs)
    assert left.columns == edge_docs.columns
    kept = sorted(i for i, (_, _, k) in brute.near_duplicates(edge_texts).items() if k)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == kept
    assert minhash_dedup.near_duplicates(empty(edge_docs)).count() == 0


def test_chains_of_links_are_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(8):  # each differs from the next by a little, the ends by much
        texts[i] = " ".join([f"n{j}" for j in range(4 * i)] + words[4 * i :])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates(texts) and len({c for _, c, _ in got.values()}) == 1


def test_a_star_with_outsiders(spark):
    """A crowd of near copies of which many are too far from all others."""
    rng = np.random.default_rng(0)
    texts = {}
    for i in range(120):
        words = [f"w{j}" for j in range(150)]
        for j in rng.choice(150, size=int(rng.integers(1, 12)), replace=False):
            words[j] = f"x{rng.integers(1e9)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates(texts)


def test_min_and_max_are_unbiased():
    from tidemark.llm.words import draws

    factors, terms = draws(400, 5) | np.uint64(1), draws(400, 7)
    x = draws(300, 1)
    a, b = (minhash_dedup.signature(s, factors, terms) for s in (x[:200], x[50:250]))
    assert len(a) == 800 and abs(float((a == b).mean()) - 150 / 250) < 0.06


# --- decontamination ---


def test_contamination_of_the_table(spark, sf, plain_texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in Q["op4_decontaminate"](spark, sf).collect():
        n, hit, ids = brute.contamination(plain_texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 12])
def test_contamination_at_the_edges(spark, edge_docs, edge_texts, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.contamination(edge_docs, bench).collect()
    assert len(rows) == edge_docs.count()
    for i, r in by_id(rows).items():
        n, hit, ids = brute.contamination(edge_texts[i], ITEMS)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, ids)
        assert sum(s.end - s.start for s in r.spans) == hit
    clean = decontaminate.keep_clean(edge_docs, bench)
    bad = {i for i in edge_texts for n, h, _ in [brute.contamination(edge_texts[i], ITEMS)] if h and 20 * h >= n}
    assert clean.columns == edge_docs.columns
    assert {r.doc_id for r in clean.collect()} - {None} == set(edge_texts) - bad


def test_contamination_of_nothing(spark, edge_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(empty(edge_docs), bench).count() == 0
    assert decontaminate.keep_clean(edge_docs, empty(bench)).count() == edge_docs.count()


def test_benchmark_blocks_hold_different_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 12)
    once, often = (spark.createDataFrame(ITEMS * n, "item_id long, text string") for n in (1, 50))
    rows = [sorted(map(str, b.collect())) for b in decontaminate._blocks(often, "item_id", "text")]
    assert rows == [sorted(map(str, b.collect())) for b in decontaminate._blocks(once, "item_id", "text")]
    assert len(rows) > 1 and sum(map(len, rows)) == len(set(ITEMS))


# --- license scan ---


def check_license(row, text):
    n, places = brute.phrase_places(text)
    starts = [i for i, _ in places]
    assert (row.n_words, row.n_base) == (n, len(places))
    assert (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))
    assert row.base_labels == ",".join(sorted({label for _, label in places}))
    assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1


def test_license_scan(spark, sf, plain_texts, edge_docs, edge_texts):
    for r in Q["op8_license_scan"](spark, sf).collect():
        check_license(r, plain_texts[r.doc_id])
    rows = license_scan.scan(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for i, r in by_id(rows).items():
        check_license(r, edge_texts[i])
    assert license_scan.scan(empty(edge_docs)).count() == 0


def test_license_spans_survive_edits(spark):
    notice = license_scan.NOTICES[1][1].split()
    edited = notice[:20] + ["really", "now"] + notice[20:40] + notice[42:]
    scrambled = sorted(notice)
    docs = spark.createDataFrame(
        [(1, "words before " + " ".join(notice)), (2, " ".join(edited)), (3, " ".join(scrambled))], "doc_id long, text string"
    )
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[1].score == 1.0 and 0.6 < got[2].score < 1.0
    assert got[3].labels == "" and got[1].base_labels == ""


def test_short_notices_one_after_the_other(spark):
    short = [text for _, text in license_scan.NOTICES if len(brute.alnum(text)) <= 8]
    texts = [sep.join([text] * n) for text in short for sep in (" ", " and ", "\n") for n in (1, 2, 3, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = dict((text, label) for label, text in license_scan.NOTICES)
    for r in license_scan.scan(docs).collect():
        assert label[short[r.doc_id // 12]] in r.labels.split(","), texts[r.doc_id]
        assert r.score == 1.0


def plain_labels(text, notices=None):
    """Labels and largest cover by diagonals worked out in plain loops."""
    words, phrases = brute.alnum(text), [(label, t) for t, label in license_scan.PHRASES]
    labels, score = set(), 0.0
    for label, notice in phrases:
        q = brute.alnum(notice)
        if any(words[i : i + len(q)] == q for i in range(len(words))):
            labels.add(label)
            score = 1.0
        else:  # a phrase of three words has one run, of two words a pair: no part counts
            score = max(score, 0.0)
    for label, notice in license_scan.NOTICES:
        q = brute.alnum(notice)
        runs = len(q) - license_scan.GRAM + 1
        on = {}
        for p in range(len(words) - license_scan.GRAM + 1):
            for j in range(runs):
                if words[p : p + license_scan.GRAM] == q[j : j + license_scan.GRAM]:
                    on.setdefault(p - j, set()).add((p, j))
        chains = []
        for d in sorted(on):
            if chains and d - chains[-1][-1] <= license_scan.MAX_SHIFT:
                chains[-1].append(d)
            else:
                chains.append([d])
        alone = [[d] for d in on if len(on[d]) >= license_scan.MIN_COVER * runs]
        for chain in chains + alone:
            held = set().union(*(on[d] for d in chain))
            cover = len({j for _, j in held}) / runs
            stretch = max(p for p, _ in held) + license_scan.GRAM - min(p for p, _ in held)
            score = max(score, cover)
            if cover >= license_scan.MIN_COVER and stretch <= license_scan.MAX_STRETCH * len(q):
                labels.add(label)
    return ",".join(sorted(labels)), score


def test_labels_equal_plain_loops(spark, sf, plain_texts, edge_docs, edge_texts):
    for rows, texts in ((Q["op8_license_scan"](spark, sf).collect(), plain_texts), (license_scan.scan(edge_docs).collect(), edge_texts)):
        for i, r in by_id(rows).items():
            if len(texts[i] or "") < 20_000:
                assert (r.labels, pytest.approx(r.score)) == plain_labels(texts[i])


def test_a_repeated_part_of_a_notice_is_no_notice(spark):
    texts = ["licensed under cc " * n for n in (1, 4, 50)] + ["Licensed under CC BY-NC 4.0. " * n for n in (1, 4, 50)]
    rng = np.random.default_rng(9)
    for _, notice in license_scan.NOTICES:
        words = notice.split()
        for _ in range(3):
            at = sorted(rng.choice(len(words) + 1, 2, replace=False))
            texts.append(" ".join(words[: at[0]] + ["other"] + words[at[0] : at[1]] * int(rng.integers(1, 4)) + words[at[1] :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[1].labels == got[2].labels == "" and got[4].labels == got[5].labels == "cc-by-nc"
    assert {i: (r.labels, pytest.approx(r.score)) for i, r in got.items()} == {i: plain_labels(t) for i, t in enumerate(texts)}


# --- quality rules ---


def test_quality_counts(spark, sf, plain_texts, edge_docs, edge_texts):
    for rows, texts in ((Q["op9_quality_rules"](spark, sf).collect(), plain_texts), (quality_rules.report(edge_docs).collect(), edge_texts)):
        for i, r in by_id(rows).items():
            counts = brute.quality_counts(texts[i])
            assert tuple(r[c] for c in quality_rules.BASE) == counts
            assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
            assert not (r.base_failed and r.kept)


def test_rules_find_bad_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [r for r in Q["op9_quality_rules"](spark, sf).collect() if not r.base_failed and r.doc_id in labels]
    good = [r.kept for r in judged if labels[r.doc_id] == 1]
    bad = [r.kept for r in judged if labels[r.doc_id] == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_expectation_maximisation(spark, sf):
    """The fitted numbers are a fixed point of a plain version started the same way."""
    voted = quality_rules.votes(quality_rules.measures(spark.read.parquet(f"{sf}/documents.parquet")))
    model = quality_rules.fit(voted)
    rows = [[r[f"vote_{n}"] for n in quality_rules.RULES] for r in voted.select(*[f"vote_{n}" for n in quality_rules.RULES]).collect()]
    p = [0.95 if r.count(0) == 0 else 0.5 if r.count(0) == 1 else 0.05 for r in rows]
    for _ in range(2000):
        good = (sum(p) + 1) / (len(p) + 2)
        chance = []
        for j in range(len(quality_rules.RULES)):
            for side in (0, 1):
                w = [q if side else 1 - q for q in p]
                cast = sum(x for x, r in zip(w, rows) if r[j] is not None)
                chance.append((sum(x for x, r in zip(w, rows) if r[j] == 0) + 1) / (cast + 2))
        following = []
        for r in rows:
            on_bad, on_good = 1 - good, good
            for j, v in enumerate(r):
                if v is not None:
                    on_bad *= chance[2 * j] if v == 0 else 1 - chance[2 * j]
                    on_good *= chance[2 * j + 1] if v == 0 else 1 - chance[2 * j + 1]
            following.append(on_good / (on_good + on_bad))
        still = max(abs(a - b) for a, b in zip(p, following)) < 1e-10
        p = following
        if still:
            break
    assert model.good == pytest.approx(good, abs=1e-4)
    assert [x for pair in model.bad_vote.values() for x in pair] == pytest.approx(chance, abs=1e-3)


def test_kept_documents_keep_their_columns(edge_docs):
    assert quality_rules.keep_good(edge_docs).columns == edge_docs.columns
    assert quality_rules.keep_good(empty(edge_docs)).count() == 0


# --- token files ---


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer())
    return lambda text: loaded.encode(text or "", add_special_tokens=False).ids + [1]


def test_token_files_of_the_table(spark, sf, plain_texts, encoder):
    got, start = by_id(Q["op1_token_files"](spark, sf).collect()), 0
    for i in sorted(plain_texts):
        ids = encoder(plain_texts[i])
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("by_words", [True, False])
def test_token_files_round_trip(spark, edge_docs, edge_texts, encoder, by_words, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 100)
    index = token_files.write(edge_docs, tokenizer(), token_files.new_folder(spark), by_words=by_words, sequence=64, batch=2)
    rows = index.collect()
    assert len(rows) == edge_docs.count()
    readers = {p: token_files.Reader(p) for p in {r.path for r in rows}}
    for r in rows:
        ids = np.concatenate(list(readers[r.path].span(r.at, r.n_tokens)))
        if r.id is not None:
            assert ids.tolist() == encoder(edge_texts[r.id])
    for path, reader in readers.items():
        used = sum(r.n_tokens for r in rows if r.path == path)
        masks = [reader.file.get_batch(b).column("mask").values.to_numpy(zero_copy_only=False) for b in range(reader.file.num_record_batches)]
        assert np.concatenate(masks).tolist() == [True] * used + [False] * (-used % 64)
        values = reader.tokens(0)
        assert not values.flags.owndata and len(values) % 64 == 0
        tokens, mask = reader.sequence_at(0)
        assert len(tokens) == len(mask) == 64
        # between its header and footer the file is an Arrow stream
        with open(path.removeprefix("file:"), "rb") as file:
            file.seek(8)
            assert pa.ipc.open_stream(file).schema.equals(reader.file.schema)
    assert token_files.read(token_files.write(empty(edge_docs), tokenizer(), token_files.new_folder(spark))).count() == 0


# --- mixing ---


def check_mix(rows, sizes_of):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = brute.mix_targets(sizes)
    for source, size in sizes.items():
        own = [r for r in rows if r.source == source]
        assert all(r.source_size == size and r.target == pytest.approx(targets[source]) for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
        left = [r.size for r in own if r.size and r.taken < (targets[source] // max(size, 1) + 1) * r.size] or [max(r.size for r in own)]
        # nothing that is left would bring the source nearer
        assert abs(sum(r.taken for r in own) - targets[source]) <= max(min(left), 1)
    assert all(r.size == sizes_of(r) for r in rows)


def test_mix_of_the_table(spark, sf, plain_texts):
    rows = Q["op6_mixing"](spark, sf).collect()
    check_mix(rows, lambda r: len(brute.spaced(plain_texts[r.doc_id])))
    assert sorted(map(str, rows)) == sorted(map(str, Q["op6_mixing"](spark, sf).collect()))


def test_mix_at_the_edges(edge_docs, edge_texts):
    rows = mixing.copies(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    check_mix(rows, lambda r: len(brute.spaced(edge_texts[r.id])) if r.id is not None else r.size)
    mix = mixing.mixed(edge_docs)
    assert mix.columns == edge_docs.columns and mix.count() == sum(r.copies for r in rows)
    assert mixing.copies(empty(edge_docs)).count() == 0


def test_weights_favour_heavy_documents(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s", 9.0 if i % 2 else 1.0) for i in range(2000)], "doc_id long, text string, source string, w double")
    rows = mixing.copies(docs, weight="w").collect()
    heavy, light = ([r.copies for r in rows if r.id % 2 == side] for side in (1, 0))
    assert sum(heavy) > sum(light)


# --- line dedup ---


def check_lines(rows, texts):
    seen = {}
    for i in sorted(texts):
        gone = []
        for number, first, n, chunk in line_dedup.chunks_of(texts[i] or ""):
            if seen.setdefault(chunk, (i, number)) != (i, number):
                gone.append((first, n))
        assert [tuple(s) for s in rows[i].removed] == gone and rows[i].n_removed == sum(n for _, n in gone)


def test_repeated_chunks(spark, sf, plain_texts):
    check_lines(by_id(Q["op2_line_dedup"](spark, sf).collect()), plain_texts)


def test_chunks_at_the_edges(edge_docs, edge_texts):
    docs = edge_docs.where("doc_id IS NOT NULL")
    check_lines(by_id(line_dedup.spans(docs).collect()), edge_texts)
    assert line_dedup.spans(edge_docs).count() == edge_docs.count() == line_dedup.clean(edge_docs).count()
    assert line_dedup.clean(edge_docs).columns == edge_docs.columns and line_dedup.spans(empty(edge_docs)).count() == 0


def test_boundaries_move_with_the_passage():
    passage = [f"line {i} of the passage" for i in range(40)]
    a, b = ["intro"] + passage, [f"other {i}" for i in range(7)] + passage
    inside = [{e - len(x) + 40 for e in line_dedup.chunk_ends(x).tolist() if e >= len(x) - 40 + 1} for x in (a, b)]
    assert inside[0] == inside[1] and len(inside[0]) > 5


def test_only_the_first_stays(spark):
    passage = "\n".join(f"line {i} of the passage" for i in range(30))
    docs = spark.createDataFrame([(1, passage), (2, "before\n" + passage + "\nafter"), (3, "own words")], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    assert clean[1] == passage and clean[3] == "own words" and len(clean[2]) < len(passage) / 2 and clean[2].startswith("before")


@pytest.mark.parametrize("n, words", [(2, 30), (3, 20), (4, 15), (5, 12), (6, 25), (10, 10), (2, 3)])
def test_short_passages_go_whole(spark, n, words):
    """Passages of a few lines, none long, between other lines in two documents."""
    docs, first, second = [], {}, {}
    for k in range(30):
        passage = [" ".join(f"p{k}l{i}w{j}" for j in range(words)) for i in range(n)]
        own = [[f"own line {k} {side} {i}" for i in range(2 * (k % 5) + 2)] for side in (0, 1)]
        first[k] = "\n".join([*own[0][:2], *passage, *own[0][2:]])
        cut = k % len(own[1])
        docs += [(k, first[k]), (100 + k, "\n".join([*own[1][:cut], *passage, *own[1][cut:]]))]
        second[100 + k] = "\n".join(own[1])
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.clean(docs).collect()} == first | second
    assert {r.n_repeated for r in line_dedup.spans(docs).collect() if r.doc_id >= 100} == {n}


def test_a_short_line_alone_stays(spark):
    texts = ["one\nsame\ntwo", "three\nsame\nfour", "a\na\na\n\nb", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    assert clean[0] == texts[0] and clean[1] == texts[1] and clean[3] == "same"
    assert clean[2].startswith("a\n") and clean[2].endswith("b")


# --- URL filter ---


def test_urls_of_the_table(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in Q["op7_url_filter"](spark, sf).collect():
        assert (r.host, r.path) == brute.split_url(urls[r.page_id])
        rule, verdict = brute.url_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_urls_at_the_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET", "x://example.net/en/1?q=/fr/", "x://example.net?a", "x://net/", "x://knet/", "a://b://c/d", "x://h/" + "s/" * 30, "x://h/\n/z"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, "x://net/", 1)], "page_id long, url string, host int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (5, 1), (99, 0), (None, 1)], "doc_id long, quality int")
    rows = url_filter.judge(pages, labels).collect()
    assert len(rows) == len(urls) + 1
    for i, r in by_id(rows, "page_id").items():
        assert (r.host, r.path) == brute.split_url(urls[i])
        assert (r.rule, r.verdict) == brute.url_rule(r.host, r.path) or r.rule is None
    assert url_filter.judge(pages.where("false"), labels).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, labels.where("false")).collect() if r.rule is None} == {"allow"}


def test_bad_templates_are_rejected(spark):
    pages = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}/page") for i in range(400)]
    labels = [(i, 0 if i % 2 else 1) for i in range(0, 400, 3)]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {(r.template, r.verdict) for r in rows} == {("/spam/*/*", "block"), ("/news/*/*", "allow")}


def test_a_small_bad_branch_among_many_is_rejected(spark):
    """40 siblings of 2.5% each; one has bad labels only."""
    pages = [(i, f"http://h.org/{'spam' if i % 40 == 7 else f'part{i % 40}'}/{i}") for i in range(4000)]
    labels = [(i, 0 if i % 40 == 7 else 1) for i in range(4000)]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {(r.template, r.verdict) for r in rows} == {("/spam/*", "block"), ("/*/*", "allow")}
    assert {r.path.split("/")[1] for r in rows if r.verdict == "block"} == {"spam"}


def test_a_bad_branch_of_few_pages_is_rejected(spark):
    """Eleven branches of 19 pages, one with bad labels only."""
    pages = [(i, f"http://h.org/{'spam' if i % 11 == 4 else f'part{i % 11}'}/{i}") for i in range(209)]
    labels = [(i, 0 if i % 11 == 4 else 1) for i in range(209)]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {(r.template, r.verdict) for r in rows} == {("/spam/*", "block"), ("/*/*", "allow")}


def plain_templates(rows):
    """{page: template}; rows: [(page, host, path, good or None)], by recursion over branches."""
    from math import comb

    out = {}

    def chance(n, x, total, hits):
        terms = {k: comb(hits, k) * comb(total - hits, n - k) / comb(total, n) for k in range(max(0, n - total + hits), min(n, hits) + 1)}
        return min(1.0, 2 * sum(p for k, p in terms.items() if (k >= x if x * total >= n * hits else k <= x)))

    def grow(held, level, template):
        for page, path, _ in held:
            if len(path) <= level:
                out[page] = template
        held = [r for r in held if len(r[1]) > level]
        known = [g for *_, g in held if g is not None]
        if not known or min(known) == max(known):
            for page, path, _ in held:
                out[page] = template + "/*" * (len(path) - level)
            return
        branches = {}
        for r in held:
            branches.setdefault(r[1][level], []).append(r)
        counts = {s: [g >= 0.5 for *_, g in b if g is not None] for s, b in branches.items()}
        tested = sum(1 for c in counts.values() if c)
        total, hits = sum(map(len, counts.values())), sum(map(sum, counts.values()))
        kept = {s for s, c in counts.items() if c and 0 < hits < total and tested * chance(len(c), sum(c), total, hits) <= url_filter.CHANCE}
        for s in kept:
            grow(branches[s], level + 1, f"{template}/{s}")
        grow([r for s, b in branches.items() if s not in kept for r in b], level + 1, f"{template}/*")

    hosts = {}
    for page, host, path, good in rows:
        hosts.setdefault(host, []).append((page, [s for s in path.split("/") if s], good))
    for held in hosts.values():
        grow(held, 0, "")
    return out


@pytest.mark.parametrize("written", [16, 2])
def test_learned_verdicts_equal_a_plain_tree(spark, monkeypatch, written):
    monkeypatch.setattr(url_filter, "WRITTEN_LEVELS", written)
    rng = np.random.default_rng(8)
    bad = {"/spam", "/a/x", "/b/b/b/y"}
    pages, labels = [], []
    for i in range(1500):
        path = "".join(f"/{rng.choice(['a', 'b', 'spam', 'x', 'y', str(i)])}" for _ in range(rng.integers(0, 6)))
        pages.append((i, f"s://h{rng.integers(0, 3)}.org{path}"))
        if rng.random() < 0.7:
            labels += [(i, int(rng.random() > (0.9 if any(path.startswith(b) for b in bad) else 0.1)))] * (1 + (i % 50 == 0))
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    good = dict(labels)
    expected = plain_templates([(i, *brute.split_url(u), good.get(i)) for i, u in pages])
    assert {r.page_id: r.template for r in rows} == expected
    overall = np.mean(list(good.values()))
    of = {}
    for i, u in pages:
        of.setdefault((brute.split_url(u)[0], expected[i]), []).extend([good[i]] if i in good else [])
    purity = {k: (sum(v) + url_filter.SMOOTHING * overall) / (len(v) + url_filter.SMOOTHING) for k, v in of.items()}
    for r in rows:
        if r.rule is None:
            assert r.verdict == ("block" if purity[r.host, r.template] < url_filter.MIN_PURITY else "allow")
    assert {r.verdict for r in rows if r.rule is None} == {"block", "allow"}


def test_siblings_that_differ_by_chance_are_merged(spark):
    rng = np.random.default_rng(5)
    pages = [(i, f"http://h.org/part{i % 300}/{i}") for i in range(9000)]
    labels = [(i, int(rng.random() < 0.7)) for i in range(9000)]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r.template for r in rows} == {"/*/*"}


def test_deep_bad_branches_are_rejected(spark):
    """The branches part at the 12th segment; the deepest paths, without labels, have 60."""
    deep = "/".join("abcdefghijk")
    pages = [(i, f"http://h.org/{deep}/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)]
    pages += [(i, f"http://g.org/{'x/' * 60}") for i in range(400, 430)]
    labels = [(i, 0 if i % 2 else 1) for i in range(0, 400, 3)]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    stars = "/*" * 11
    assert {(r.template, r.verdict) for r in rows} == {(f"{stars}/spam/*", "block"), (f"{stars}/news/*", "allow"), ("/*" * 60, "allow")}
