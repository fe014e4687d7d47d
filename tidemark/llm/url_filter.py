"""URL filters: listed rules first, else a tree of path templates learned per host.

The tree grows a level at a time. Below a template, a path segment stays a branch of its own, however
few or many rows it has, when its labels differ from those of its siblings by more than chance: an
exact test, in which the chance allowed is shared among all siblings that have labels. All others,
variable or statistically alike, are merged into the wildcard `*`. So a template is a host and a path
of kept segments and wildcards. A template is rejected when its purity, the share of good labels
smoothed towards the share of all, is too low.

Statistics are sums that are combined before the exchange; the joins back to the pages are plain
equi-joins, whose hot hosts adaptive execution splits. Rows whose template has no different labels
left get wildcards for all further segments at once; the others go on to the end of their paths,
however deep, and what is decided is written every `WRITTEN_LEVELS` levels.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and
falls under the template of the empty host; a very long url is judged whole. Several labels of one
page are averaged, and count as good in the test from one half on; pages without a label count in
frequencies only. Repeated rows are judged each, and urls alike alike; of rules of equal length that
fit, the last in code-point order wins. Without any label nothing is rejected. No pages give an empty
result. Extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.skew import materialize

# (rule, verdict): a rule is a host, which covers its subdomains, and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
CHANCE = 0.01  # that any sibling stays a branch though all are alike
WRITTEN_LEVELS = 16
SMOOTHING = 10.0
MIN_PURITY = 0.5
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def two_sided(labelled: np.ndarray, good: np.ndarray, all_labelled: np.ndarray, all_good: np.ndarray) -> np.ndarray:
    """Twice the chance that so many or more (few) of `labelled` draws are good, drawn without replacement from all.

    Terms are added from the observed number outwards until they no longer count.
    """
    n, x, total, hits = (np.asarray(v, dtype=np.float64) for v in (labelled, good, all_labelled, all_good))
    log_choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = np.exp(log_choose(hits, x) + log_choose(total - hits, n - x) - log_choose(total, n))
        up = x * total >= n * hits  # away from what is expected
        tail, at, going = term.copy(), x.copy(), term > 0
        while going.any():
            above = (hits - at) * (n - at) / ((at + 1) * (total - hits - n + at + 1))
            below = at * (total - hits - n + at) / ((hits - at + 1) * (n - at + 1))
            term = np.where(going, term * np.where(up, above, below), 0.0)
            tail += term
            at += np.where(up, 1, -1)
            going = term > 1e-12 * tail
    return np.minimum(2 * tail, 1.0)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    values, which = np.unique(n, return_inverse=True)
    return np.array([math.lgamma(v + 1) if v >= 0 else math.inf for v in values.tolist()])[which]


@F.arrow_udf(T.DoubleType())
def _by_chance(labelled: pa.Array, good: pa.Array, all_labelled: pa.Array, all_good: pa.Array) -> pa.Array:
    return pa.array(two_sided(*(c.to_numpy(zero_copy_only=False) for c in (labelled, good, all_labelled, all_good))))


def _kept(rows: DataFrame) -> DataFrame:
    """Segments that stay branches: host, template, segment."""
    sums = [F.count("good").alias("labelled"), F.count_if(F.col("good") >= 0.5).alias("good")]
    below = rows.groupBy("host", "template", "segment").agg(*sums).where("labelled > 0")
    above = below.groupBy("host", "template").agg(
        F.count("*").alias("tested"), F.sum("labelled").alias("all_labelled"), F.sum("good").alias("all_good")
    )
    both = below.join(above.where("all_good BETWEEN 1 AND all_labelled - 1"), ["host", "template"])
    chance = _by_chance("labelled", "good", "all_labelled", "all_good")
    return both.where(F.col("tested") * chance <= CHANCE).select("host", "template", "segment", F.col("segment").alias("kept"))


def _undecided(rows: DataFrame) -> DataFrame:
    """The (host, template) below which a segment may still stay a branch: those with labels that differ."""
    below = rows.groupBy("host", "template").agg(F.min("good").alias("low"), F.max("good").alias("high"))
    return below.where(F.col("low") < F.col("high")).select("host", "template", F.lit(True).alias("undecided"))


def templates(pages: DataFrame) -> DataFrame:
    """Adds template to rows of (host, path, good)."""
    rows = pages.withColumn("segments", _segments(F.col("path"))).withColumn("template", F.lit(""))
    done, level = None, 0
    while True:  # as deep as the paths of undecided templates
        further = F.size("segments") > level
        undecided = materialize(_undecided(rows.where(further)), "undecided")
        rows = rows.join(undecided, ["host", "template"], "left").withColumn("undecided", F.col("undecided").isNotNull() & further)
        rest = F.repeat(F.lit("/*"), F.greatest(F.size("segments") - level, F.lit(0)))
        ready = rows.where(~F.col("undecided")).withColumn("template", F.concat("template", rest)).drop("segments", "undecided")
        done = ready if done is None else done.unionByName(ready)
        if undecided.isEmpty():
            return done
        rows = rows.where("undecided").drop("undecided").withColumn("segment", F.get("segments", F.lit(level)))
        rows = rows.join(_kept(rows.select("host", "template", "segment", "good")), ["host", "template", "segment"], "left")
        branch = F.concat("template", F.lit("/"), F.coalesce("kept", F.lit("*")))
        rows = materialize(rows.withColumn("template", branch).drop("segment", "kept"), "templates")
        level += 1
        if level % WRITTEN_LEVELS == 0:
            done = materialize(done, "decided")


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Per page: key, host, path, rule, verdict, template, purity."""
    link = F.col(f"`{url}`")
    slim = pages.select(F.col(f"`{key}`").alias("id"), host_of(link).alias("host"), path_of(link).alias("path"))
    known = labels.groupBy(F.col(f"`{label_key}`").alias("id")).agg(F.avg(F.col(f"`{label}`")).alias("good"))
    slim = materialize(slim.join(known, "id", "left"), "urls")
    overall = slim.agg(F.avg("good")).head()[0]
    rows = templates(slim)
    purity = (F.coalesce(F.sum("good"), F.lit(0.0)) + SMOOTHING * (1.0 if overall is None else overall)) / (F.count("good") + SMOOTHING)
    judged = rows.groupBy("host", "template").agg(purity.alias("purity"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    learned = F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")
    return rows.join(judged, ["host", "template"]).select(
        F.col("id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "template", "purity"
    )
