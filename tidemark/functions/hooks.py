"""Where a caller's model, scorer or writer plugs in. Each runs in Arrow batches on executors."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Batch sizes and the retry rule.
DENSE_BATCH = 32
TOKEN_BATCH = 8
ATTEMPTS = 4
LONGEST_WAIT = 30.0
RETRY_STATUS = (429, 500, 502, 503, 504)

ERROR_LENGTH = 2000

Embed = Callable[[list[str]], list]
Score = Callable[[str, list[str]], list[float]]


class TransientError(Exception):
    """Raise this in a hook for a failure worth trying again; `status` may be None."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def with_retry(call: Callable, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Try again on transient failures, doubling the wait; anything else is raised at once."""

    def tried(*args):
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return call(*args)
            except TransientError as failure:
                lasting = failure.status is not None and failure.status not in RETRY_STATUS
                if lasting or attempt == ATTEMPTS:
                    raise
                sleep(min(2.0 ** (attempt - 1), LONGEST_WAIT))

    return tried


def outcome(failure: Exception) -> str:
    """What a failed row keeps, as text.error_message: the start of the message, or the class name if it is empty."""
    return str(failure)[:ERROR_LENGTH] or type(failure).__name__


def _whole(call: Callable[[list], list], items: list) -> list[tuple]:
    made = call(items)
    if len(made) != len(items):
        raise ValueError("the model must give one vector per text")
    return [(x, None) for x in made]


def _each(call: Callable[[list], list], items: list) -> list[tuple]:
    """(result, error) per item. A batch that fails is tried again item by item, so only bad items fail."""
    try:
        return _whole(call, items)
    except Exception as failure:
        if len(items) == 1:
            return [(None, outcome(failure))]
        return [pair for item in items for pair in _each(call, [item])]


def embedded(
    df: DataFrame, text: str, make: Callable[[], Embed], per_token: bool = False, out: str = "embedding", error: str | None = None
) -> DataFrame:
    """`df` plus a vector per text (or one per token). `make` builds the model once per task.

    A text that fails fails the job, unless `error` names a column for the message; then its vector
    is null and all other texts have theirs.
    """
    vector = T.ArrayType(T.FloatType())
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(vector) if per_token else vector)])
    if error:
        schema = schema.add(error, T.StringType())
    size = TOKEN_BATCH if per_token else DENSE_BATCH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(make())
        for batch in batches:
            texts = batch[text].tolist()
            made: list[tuple] = []
            for at in range(0, len(texts), size):
                made.extend((_each if error else _whole)(call, texts[at:at + size]))
            told = {error: [e for _, e in made]} if error else {}
            yield batch.assign(**{out: pd.Series([v for v, _ in made], index=batch.index, dtype=object)}, **told)

    return df.mapInPandas(run, schema)


def pair_scorer(make: Callable[[], Score]):
    """A scorer(query, texts) as a column function of (query, text); a missing text scores as ""."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        call = with_retry(make())
        for queries, texts in batches:
            scores = pd.Series(0.0, index=texts.index)
            for query, part in texts.fillna("").groupby(queries):
                scores.loc[part.index] = call(query, part.tolist())
            yield scores

    return score


def word_splitter(make: Callable[[], Callable[[str], Sequence[str]]]) -> Callable[[Column], Column]:
    """A word segmenter for `text.tokenize(..., split_words=...)`: words come back spaced."""

    @F.pandas_udf("string")
    def spaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = make()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else " ".join(split(t)))

    return spaced


def written(
    df: DataFrame, make: Callable[[], Callable[[dict], list[dict]]], schema: str, error: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows a writer makes from each input row (eval samples, hypothetical passages).

    Save the result before using it twice: a recomputed task would call the writer again. With
    `error`, an input row that fails gives one row of its `keys`, the message, and nulls.
    """

    full = T.StructType.fromDDL(schema)
    if error:
        full = full.add(error, T.StringType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        write = with_retry(make())
        for batch in batches:
            rows: list[dict] = []
            for row in batch.to_dict("records"):
                try:
                    rows.extend(write(row))
                except Exception as failure:
                    if not error:
                        raise
                    rows.append({**{k: row[k] for k in keys}, error: outcome(failure)})
            made = pd.DataFrame(rows, columns=full.names)
            yield made.astype(object).where(made.notna(), None) if error else made

    return df.mapInPandas(run, full)


@F.pandas_udf(T.LongType())
def term_id(terms: pd.Series) -> pd.Series:
    """A term's 32-bit number in indexes that address terms by hash."""
    return terms.map(
        lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big")
    )
