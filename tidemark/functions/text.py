"""Text as Column expressions: markup, digits, terms, sentences, match keys, highlights.

All but the cutting of words into terms is a composition of built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results depend on these exact patterns, digits and character sets.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
ASCII_DIGITS = "0123456789"
MARKUP_STEPS = (
    (r"(?is)<page_number>.*?</page_number>", " "),
    (r"(?i)<br\s*/?>", " "),
    (r"(?i)</t[dh]>", " | "),
    (r"(?i)</tr>", "\n"),
    (r"<[^>]+>", " "),
    (r"(?U)[^\S\n]*(\|[^\S\n]*)+", " | "),
    (r"(?md)^ \| | \| $", ""),
)
# Thai marks by code point: e31, e34-e39 vowels above and below, e30 e32 e33 e45 after and e40-e44 before
# a consonant, e48-e4b tones, e3a e47 e4c-e4e other signs.
MARKS = r"[\x{e30}-\x{e3a}\x{e40}-\x{e4e}\x{200b}\x{200c}]"
MARK_RULES = (
    (r"[\x{200b}\x{200c}]", ""),  # of no width
    (r"\x{e40}\x{e40}", "แ"),  # one sign typed as two
    (r"([\x{e48}-\x{e4c}]+)([\x{e31}\x{e34}-\x{e39}]+)", "$2$1"),  # vowel before tone
    (r"\x{e4d}([\x{e48}-\x{e4b}]*)\x{e32}", "$1ำ"),  # decomposed
    (r"([\x{e30}\x{e32}\x{e33}\x{e45}]+)([\x{e48}-\x{e4b}]+)", "$2$1"),  # tone before a vowel that follows
    (r"([\x{e30}-\x{e3a}\x{e40}-\x{e45}\x{e47}\x{e4c}-\x{e4e}])\1+", "$1"),  # typed twice
    (r"[\x{e48}-\x{e4b}]+([\x{e48}-\x{e4b}])", "$1"),  # the last of several tones
    (r"^[\x{e31}\x{e34}-\x{e3a}\x{e47}-\x{e4e}]+", ""),  # nothing to stand on
)
DIGIT_GROUP = r",(?<=\d,)(?=\d\d\d)"
REPEAT_MARK = r"(?U)\s*ๆ"
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # (?U)\s
STRIPPED = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
JOINERS = "-–—/\\"
TERM_EDGE = "\"'“”‘’()[]{}<>:;,.|/\\-–—…!?*=+#&~`"
TERM_KEEP = "[ก-ฮะ-์a-zA-Z0-9]"
RARE_SIGNS = r"[<|\x{e00}-\x{e7f}\x{200b}\x{200c}]"  # markup, Thai: all that the first steps of tokenize change
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+|\n+"
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
ERROR_LENGTH = 2000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once, however often `body` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def linearize_markup(text: Column) -> Column:
    """Table and page markup to plain lines: cells joined by ` | `, one row per line."""
    for pattern, replacement in MARKUP_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def normalize_marks(text: Column) -> Column:
    """Marks in their usual order and once each, so that different ways to type a word meet. Other text is passed by."""
    marked = text
    for pattern, replacement in MARK_RULES:
        marked = F.regexp_replace(marked, pattern, replacement)
    return F.when((F.octet_length(text) > F.length(text)) & text.rlike(MARKS), marked).otherwise(text)


def fold_digits(text: Column) -> Column:
    return F.translate(text, THAI_DIGITS, ASCII_DIGITS)


def ungroup_digits(text: Column) -> Column:
    """`1,000,000` becomes `1000000`; other commas stay."""
    return F.regexp_replace(text, DIGIT_GROUP, "")


def _plain(text: Column) -> Column:
    """Text with rare signs without its markup, marks in order, digits folded and repeat marks gone."""

    def ordered(text: Column) -> Column:
        return ungroup_digits(fold_digits(normalize_marks(text)))

    marked = F.contains(text, F.lit("<")) | F.contains(text, F.lit("|"))
    return F.regexp_replace(let(F.when(marked, linearize_markup(text)).otherwise(text), ordered), REPEAT_MARK, "")


def _words(texts: pa.Array) -> pa.ListArray:
    """Texts cut at joiners and white space."""
    for sign in JOINERS:
        texts = pc.replace_substring(texts, sign, " ")
    if not pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        return pc.utf8_split_whitespace(texts)
    cut = re.compile(f"[{SPACES}]+").split  # without four signs that are taken for white space above
    return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def _as_terms(words: pa.Array) -> pa.Array:
    """Words to terms, "" where nothing is kept."""
    trimmed = pc.utf8_trim(words, TERM_EDGE)
    terms = pc.if_else(pc.match_substring_regex(trimmed, TERM_KEEP), trimmed, "")
    plain = pc.string_is_ascii(terms)
    others = [t.lower() for t in terms.filter(pc.invert(plain)).to_pylist()]
    return pc.replace_with_mask(pc.ascii_lower(terms), pc.invert(plain), pa.array(others, pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _terms(texts: pa.Array) -> pa.Array:
    """Every distinct word of a batch is looked at once."""
    cut = _words(texts)
    size = pc.fill_null(pc.list_value_length(cut), 0).to_numpy()
    words = cut.flatten().dictionary_encode()
    terms = _as_terms(words.dictionary)
    place = words.indices.to_numpy()
    kept = pc.greater(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)[place]
    ends = np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(size)]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms.take(pa.array(place[kept])), mask=texts.is_null())


def tokenize(text: Column, split_words: Callable[[Column], Column] | None = None) -> Column:
    """Text to an array of lower-case index terms, repeats kept.

    Rare signs are seen to in the JVM, by a `let`, so that its steps do not swell the generated code
    of all rows. Cutting at white space and trimming words is done in Arrow, a distinct word of a batch
    once, so no word of a text becomes a Python object.

    `split_words` may cut unspaced scripts into words: it maps the cleaned text to text whose
    words are separated by whitespace. The same function must be used for texts and queries.
    """
    text = F.when(text.rlike(RARE_SIGNS), let(text, _plain)).otherwise(ungroup_digits(text))
    if split_words is not None:
        text = split_words(F.translate(text, JOINERS, " " * len(JOINERS)))
    return _terms(text)


def normalize_for_match(text: Column) -> Column:
    """Whitespace dropped and digits folded, so line breaks never hide a match."""
    return F.regexp_replace(fold_digits(text), WHITESPACE, "")


def kept_positions(text: Column) -> Column:
    """For each character `normalize_for_match` keeps, its 0-based place in `text`."""
    places = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)))
    return F.filter(
        places,
        lambda i: (F.length(text) > 0) & ~F.substring(text, i + 1, F.lit(1)).rlike(WHITESPACE),
    )


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: F.length(normalize_for_match(s)) > 0)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIPPED))


def merge_spans(spans: Column) -> Column:
    """Sorted `[start, end)` spans, each clipped to begin where the ones before it ended."""
    empty = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def step(state: Column, span: Column) -> Column:
        start = F.greatest(span["start"], state["at"])
        kept = F.concat(
            state["out"], F.array(F.struct(start.alias("start"), span["end"].alias("end")))
        )
        return F.when(start >= span["end"], state).otherwise(
            F.struct(span["end"].alias("at"), kept.alias("out"))
        )

    return F.aggregate(spans, empty, step)["out"]


def mark_spans(text: Column, spans: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """`text` with the merged spans wrapped in `opening` and `closing`."""
    merged = merge_spans(spans)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, span["start"] - acc["at"])
        inside = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        return F.struct(
            span["end"].alias("at"),
            F.concat(acc["out"], before, F.lit(opening), inside, F.lit(closing)).alias("out"),
        )

    done = F.aggregate(merged, state, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def error_message(message: Column, exception_class: Column) -> Column:
    """What a failed row keeps: the start of the message, or the class name if it is empty."""
    return F.coalesce(F.nullif(F.left(message, F.lit(ERROR_LENGTH)), F.lit("")), exception_class)
