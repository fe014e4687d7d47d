"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Built from DataFrame functions alone. Each rule looks at a few counts of a document and votes good,
bad or not at all. Documents are then counted by their pattern of votes (at most 3 ** rules
patterns, whatever the corpus), and expectation-maximisation over that table estimates the share of
good documents and, per rule, how often it votes bad on bad and on good documents. A document is
kept when its posterior probability of being good is at least one half.

Defined results: a very long text counts whole; a posterior of exactly one half keeps; a null or empty text has no words, gets the base failure of a short text and goes.
Equal rows get equal results; an empty table gives an empty result. Rows are never joined or
grouped by document, so ids may repeat or be null, and extra columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import packed, spaced_words, unpacked
from tidemark.plans.skew import materialize

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Frequent short words of English, French, German and Spanish.
COMMON = (
    "the of and to in is that for it with la le les de et des un une der die das und ist von zu en el los las que y"
).split()

# rule: (measure, divided by, bad if, good if). A rule abstains between its limits, and where the
# divisor is 0.
RULES = {
    "length": ("n_words", None, "< 30", ">= 60"),
    "symbols": ("n_symbols", "n_words", "> 0.1", "< 0.02"),
    "duplicate_lines": ("n_dup_lines", "n_lines", "> 0.3", "< 0.1"),
    "repeated_words": ("n_repeat_words", "n_words", "> 0.2", "< 0.05"),
    "capitals": ("n_capitals", "word_chars", "> 0.4", "< 0.15"),
    "exclamations": ("n_exclamations", "n_words", "> 0.2", "< 0.02"),
    "word_length": ("word_chars", "n_words", "> 12", "< 9"),
    "line_ends": ("n_closed_lines", "n_lines", "< 0.1", "> 0.5"),
    "common_words": ("n_common", "n_words", "< 0.03", "> 0.1"),
}
SMOOTHING = 1.0
CONVERGED = 1e-6  # largest change of a share or chance in a round
MOST_ROUNDS = 500


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _joined(step: int):
    return lambda x, i: F.xxhash64(x, F.get(F.col("_h"), i + step))


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from `_words`: words covered by windows that occur twice or more.

    Window hashes are built by doubling (1, 2, 4, 8 words) and sorted with their places; equal
    neighbours are repeats. Only documents that have any repeat pay for the sort.
    """
    df = df.withColumn("_h", F.when(F.size("_words") >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))))
    step = 1
    while step < WINDOW:
        kept = F.slice("_h", F.lit(1), F.size("_h") - step)
        df = df.withColumn("_h", F.transform(kept, _joined(step)))
        step *= 2
    df = df.withColumn("_twice", F.size(F.array_distinct("_h")) < F.size("_h"))
    df = df.withColumn(
        "_h", F.when(F.col("_twice"), F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    )
    same = lambda j, x: F.coalesce(F.get(F.col("_h"), j)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_h", F.filter("_h", lambda x, j: same(j - 1, x) | same(j + 1, x)))
    df = df.withColumn("_h", F.array_sort(F.transform("_h", lambda x: x["i"])))
    covered = F.transform("_h", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_h"), j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_h", "_twice")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The packed row and every count the rules use; see `RULES` and `BASE`."""
    df = packed(docs, _text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn("_words", spaced_words(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(_without(x, " \t\n\x0b\f\r")) > 0))
    df = _repeat_words(df)
    solid = _without(F.col("_text"), " \t\n\x0b\f\r")
    return df.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike("[.!?]$"))).cast("long").alias("n_closed_lines"),
        (F.length("_text") - F.length(_without(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_capitals"),
        (F.length("_text") - F.length(_without(F.col("_text"), "!"))).cast("long").alias("n_exclamations"),
        F.size(F.filter("_words", lambda w: w.isin(COMMON))).cast("long").alias("n_common"),
    )


def _vote(rule: str) -> Column:
    over, by, bad, good = RULES[rule]
    value = over if by is None else f"({over} / nullif({by}, 0))"
    return F.expr(f"CASE WHEN {value} {bad} THEN 0 WHEN {value} {good} THEN 1 END")


def votes(measured: DataFrame) -> DataFrame:
    """Adds base_failed and one vote per rule: 1 good, 0 bad, null abstains."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumns({f"vote_{r}": _vote(r) for r in RULES})


@dataclass(frozen=True)
class Accuracies:
    """good: share of good documents. bad_vote: per rule, chance of a bad vote on (bad, good) documents."""

    good: float
    bad_vote: dict[str, tuple[float, float]]

    def distance(self, other: Accuracies) -> float:
        """The largest difference of two estimates."""
        mine, theirs = ([m.good, *(x for pair in m.bad_vote.values() for x in pair)] for m in (self, other))
        return max(abs(a - b) for a, b in zip(mine, theirs))

    def chance(self, cast: tuple) -> float:
        """Posterior probability of being good, given votes in the order of RULES."""
        odds = math.log(self.good / (1 - self.good))
        for vote, (on_bad, on_good) in zip(cast, self.bad_vote.values()):
            if vote is not None:
                odds += math.log(on_good / on_bad) if vote == 0 else math.log((1 - on_good) / (1 - on_bad))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    def log_odds(self) -> Column:
        """Natural log of the odds of being good, given a row's votes."""
        total = F.lit(math.log(self.good / (1 - self.good)))
        for rule, (on_bad, on_good) in self.bad_vote.items():
            vote = F.col(f"vote_{rule}")
            total = total + F.when(vote == 0, math.log(on_good / on_bad)).when(
                vote == 1, math.log((1 - on_good) / (1 - on_bad))
            ).otherwise(0.0)
        return total

    def probability(self) -> Column:
        """Posterior probability of being good; far odds are cut at e**30, which changes no verdict."""
        odds = F.least(F.greatest(self.log_odds(), F.lit(-30.0)), F.lit(30.0))
        return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, rounds: int = MOST_ROUNDS) -> Accuracies:
    """Expectation-maximisation over the counted vote patterns, until the numbers stand still.

    Starts from the number of bad votes (none: good with 0.95, one: 0.5, more: 0.05). Spark counts the
    patterns; their table, 3 ** rules rows at most whatever the corpus, is all the rounds need. They
    end when no estimate moves by CONVERGED any more, or after `rounds`.
    """
    names = [f"vote_{r}" for r in RULES]
    patterns = sorted(
        ((tuple(r[v] for v in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()),
        key=lambda row: [-1 if v is None else v for v in row[0]],
    )
    total = sum(n for _, n in patterns)
    start = {0: 0.95, 1: 0.5}
    probability = [start.get(cast.count(0), 0.05) for cast, _ in patterns]
    model = Accuracies(0.5, {r: (0.5, 0.5) for r in RULES})
    share = lambda part, whole: (part + SMOOTHING) / (whole + 2 * SMOOTHING)
    for _ in range(rounds):
        weights = [(n * (1 - p), n * p) for (_, n), p in zip(patterns, probability)]
        bad_vote = {}
        for j, rule in enumerate(RULES):
            sides = []
            for side in (0, 1):
                bad = sum(w[side] for w, (cast, _) in zip(weights, patterns) if cast[j] == 0)
                voting = sum(w[side] for w, (cast, _) in zip(weights, patterns) if cast[j] is not None)
                sides.append(share(bad, voting))
            bad_vote[rule] = (sides[0], sides[1])
        before, model = model, Accuracies(share(sum(good for _, good in weights), total), bad_vote)
        if model.distance(before) < CONVERGED:
            break
        probability = [model.chance(cast) for cast, _ in patterns]
    return model


def judged(voted: DataFrame, model: Accuracies) -> DataFrame:
    """Adds p_good and kept."""
    return voted.withColumn("p_good", model.probability()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame, text: str = "text", rounds: int = MOST_ROUNDS) -> DataFrame:
    """The documents that pass, with their own columns. Counts once, writes votes beside the rows, shuffles no text."""
    names = [f"vote_{r}" for r in RULES]
    # rows that go in any case vote, but are not written
    voted = votes(measures(docs, text)).select(F.when(~F.col("base_failed"), F.col("_row")).alias("_row"), "base_failed", *names)
    voted = materialize(voted, "voted_rows", "zstd")
    return unpacked(judged(voted, fit(voted, rounds)).where("kept"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = MOST_ROUNDS) -> DataFrame:
    """Per document: key, base counts, votes, base_failed, p_good, kept."""
    slim = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))
    voted = votes(measures(slim)).withColumn(key, F.col(f"_row.{key}")).drop("_row")
    voted = materialize(voted, "rule_votes")
    return judged(voted, fit(voted, rounds))
