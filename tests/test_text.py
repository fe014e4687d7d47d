import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.hooks import term_id, word_splitter
from tidemark.operators import index


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*map(F.col, names)).alias("v")).head()["v"]


@pytest.mark.parametrize("text, terms", [
    ("<tr><td></td><td>-</td></tr>", []),
    ("<figure>\nA gold-colored coin featuring a portrait of King Chulalongkorn.\n</figure>",
     ["a", "gold", "colored", "coin", "featuring", "a", "portrait", "of", "king", "chulalongkorn"]),
    ("1,000,000 baht", ["1000000", "baht"]),
    ("๑,๐๐๐,๐๐๐ baht", ["1000000", "baht"]),
    ("<td>12</td><td>12</td>", ["12", "12"]),
    ("Nickel<br/>25", ["nickel", "25"]),
    ("<page_number>- ๒ -</page_number> coin", ["coin"]),
    ("(96.5), \"Bi-metal\" gram / gm.", ["96.5", "bi", "metal", "gram", "gm"]),
    ("ต่าง ๆ", ["ต่าง"]),
    ("  \n ", []),
    ("a,1000 1,00 1,2345", ["a,1000", "1,00", "12345"]),
])
def test_tokenize(spark, text, terms):
    assert one(spark, X.tokenize, text) == terms


def test_linearize_table(spark):
    text = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    lines = [line.strip() for line in one(spark, X.linearize_markup, text).split("\n")]
    assert lines == ["a | b", "c | d", ""]


def test_normalize_and_positions(spark):
    assert one(spark, X.normalize_for_match, "a b\n c") == "abc"
    assert one(spark, X.kept_positions, "a b\n c") == [0, 2, 5]
    assert one(spark, X.kept_positions, "") == []


def test_sentences(spark):
    assert one(spark, X.split_sentences, "Refunds take 30 days. Contact billing.\n\n \nNo? Yes!") == [
        "Refunds take 30 days.", "Contact billing.", "No?", "Yes!"]


def test_highlights_merge(spark):
    spans = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((0, 3), (2, 5), (3, 4), (7, 9))))
    assert one(spark, lambda t: X.mark_spans(t, spans, "[", "]"), "abcdefghij") == "[abc][de]fg[hi]j"


def test_term_weights(spark):
    terms = F.array(*map(F.lit, ("x", "y", "x")))
    got = {r["term"]: r for r in one(spark, lambda _: index.weighted_terms(terms), "")}
    assert got["x"]["tf"] == 2
    assert got["x"]["weight"] == pytest.approx(2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 256)))
    weights = [one(spark, lambda _: index.term_weight(F.lit(float(tf)), F.lit(60)), "") for tf in (1, 2, 5, 50)]
    assert weights == sorted(weights) and max(weights) < 2.2


def test_terms_of_a_long_row_are_counted_in_one_pass(spark):
    """Comparing every term with every other takes minutes here."""
    import time

    begun = time.monotonic()
    row = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(119_999)), lambda i: F.concat(F.lit("t"), i % 100_000)).alias("t"))
    got = row.select(F.explode(index.weighted_terms("t")).alias("w")).agg(F.count("*"), F.sum("w.tf"), F.max("w.tf")).head()
    assert tuple(got) == (100_000, 120_000, 2) and time.monotonic() - begun < 20


def test_words_are_cut_outside_generated_code(spark):
    text = "\x1c a-b\u2003(C)\x85..d\x1ce.. ~ é 1,000,000\u3000ก,ๆ000"
    assert one(spark, X.tokenize, text) == ["a", "b", "c", "d\x1ce", "1000000", "ก,000"]
    plan = spark.createDataFrame([("a",)], "t string").select(X.tokenize(F.col("t")))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan
    assert one(spark, X.strip, "\u2003\x1f a\u00a0b \u3000\n") == "a\u00a0b"


def test_term_id_and_splitter(spark):
    import hashlib

    expected = int.from_bytes(hashlib.blake2b(b"coin", digest_size=4).digest(), "big")
    assert one(spark, term_id, "coin") == expected
    pairs = word_splitter(lambda: lambda t: [t[i:i + 2] for i in range(0, len(t), 2)])
    assert one(spark, lambda t: X.tokenize(t, pairs), "เงินตรา") == ["เง", "ิน", "ตร", "า"]


def test_error_message(spark):
    assert len(one(spark, lambda m, c: X.error_message(m, c), "x" * 5000, "ValueError")) == 2000
    assert one(spark, lambda m, c: X.error_message(m, c), "", "ValueError") == "ValueError"


def test_ways_to_type_a_word_meet(spark):
    """Code points out of order, doubled, decomposed or of no width."""
    word = lambda *points: "".join(map(chr, points))
    pairs = [
        (word(0xE19, 0xE4D, 0xE49, 0xE32), word(0xE19, 0xE49, 0xE33)),  # decomposed, tone between
        (word(0xE19, 0xE4D, 0xE32), word(0xE19, 0xE33)),
        (word(0xE40, 0xE40, 0xE21), word(0xE41, 0xE21)),  # two signs for one
        (word(0xE17, 0xE48, 0xE35), word(0xE17, 0xE35, 0xE48)),  # tone typed before its vowel
        (word(0xE01, 0xE32, 0xE48), word(0xE01, 0xE48, 0xE32)),
        (word(0xE14, 0xE35, 0xE35, 0xE35), word(0xE14, 0xE35)),  # typed twice
        (word(0xE01, 0xE48, 0xE49, 0xE32), word(0xE01, 0xE49, 0xE32)),  # two tones
        (word(0xE01, 0x200B, 0xE02), word(0xE01, 0xE02)),
        (word(0xE48, 0xE01), word(0xE01)),
    ]
    rows = [(i, side, f"MIX {t} 12") for i, p in enumerate(pairs) for side, t in enumerate(p)]
    df = spark.createDataFrame(rows, "i int, side int, t string")
    got = {(r["i"], r["side"]): r["x"] for r in df.select("i", "side", X.tokenize(F.col("t")).alias("x")).collect()}
    for i in range(len(pairs) - 1):
        assert got[i, 0] == got[i, 1] and len(got[i, 0]) == 3
    alone = spark.createDataFrame([(a, b) for a, b in pairs] + [("caf\u00e9 \u4e2d", "caf\u00e9 \u4e2d"), ("plain", "plain"), (None, None)], "a string, b string")
    assert all(r["a"] == r["b"] for r in alone.select(X.normalize_marks(F.col("a")).alias("a"), "b").collect())


def test_a_batch_looks_at_a_distinct_word_once(monkeypatch):
    looked, plain = [], X._as_terms
    monkeypatch.setattr(X, "_as_terms", lambda words: looked.extend(words.to_pylist()) or plain(words))
    terms = X._terms.func(pa.array(["Red red/blue", None, "", "red \x1c!! Red É9"] * 50))
    assert terms.to_pylist() == [["red", "red", "blue"], None, [], ["red", "red", "é9"]] * 50
    assert len(looked) == len(set(looked))
