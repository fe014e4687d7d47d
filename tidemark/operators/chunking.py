"""Pages to documents to parent chunks to child chunks.

Tables: pages(kb_id, doc_id, source, page_index, markdown), documents(kb_id, doc_id, source,
text), parents(kb_id, doc_id, source, parent_id, seq, start, content), children(kb_id, doc_id,
source, parent_id, child_id, seq, content). Ids are hashes of position, so a task that runs
twice writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.config import CHILD_OVERLAP, CHILD_SIZE, MIN_PARENT_SIZE, PARENT_SIZE
from tidemark.functions.splitting import SENTENCE_BREAKS, TAG_BREAKS, TEXT_BREAKS, joined, split_spans
from tidemark.functions.text import strip
from tidemark.functions.vectors import cosines
from tidemark.plans.skew import Ordered

PAGE_JOIN = "\n\n"
ID_LENGTH = 21
PIECES = "array<struct<start:int,content:string>>"
SCAN_BLOCK = 4096


def stable_id(kind: str, *parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256), F.lit(ID_LENGTH))


# --- pages ----------------------------------------------------------------------------------


def join_pages(pages: DataFrame) -> DataFrame:
    """One text per document, pages joined by a blank line in page order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "markdown")))
    return pages.groupBy("kb_id", "doc_id", "source").agg(
        F.array_join(F.transform(ordered, lambda p: p["markdown"]), PAGE_JOIN).alias("text")
    )


def page_spans(pages: DataFrame) -> DataFrame:
    """Where each page lies in its document's joined text, as `[start, end)`."""
    sized = pages.select(
        "kb_id",
        "doc_id",
        "page_index",
        F.length("markdown").alias("_length"),
        (F.length("markdown") + len(PAGE_JOIN)).cast("long").alias("_step"),
    )
    total = Ordered(sized, ["kb_id", "doc_id"], ["page_index"]).total("_step", "_through").done()
    start = F.col("_through") - F.col("_step")
    return total.select(
        "kb_id", "doc_id", "page_index", start.alias("start"), (start + F.col("_length")).alias("end")
    )


def chunk_pages(parents: DataFrame, spans: DataFrame) -> DataFrame:
    """Each parent with the sorted indexes of the pages it touches.

    Both sides are cut into stretches of the document, so a long document becomes many small
    join keys; an overlap is counted only in the first stretch both sides share.
    """

    def stretched(df: DataFrame, start: Column, end: Column) -> DataFrame:
        first = F.floor(start / SCAN_BLOCK)
        last = F.floor(F.greatest(end - 1, start) / SCAN_BLOCK)
        return df.withColumn("_first", first).withColumn(
            "_stretch", F.explode(F.sequence(first, last))
        )

    chunks = stretched(
        parents.select(
            "kb_id", "doc_id", "parent_id", F.col("start").alias("_s"),
            (F.col("start") + F.length("content")).alias("_e"),
        ),
        F.col("_s"), F.col("_e"),
    ).withColumnRenamed("_first", "_chunk_first")
    pages = stretched(spans, F.col("start"), F.col("end"))
    touching = chunks.join(pages, ["kb_id", "doc_id", "_stretch"]).where(
        (F.col("start") < F.col("_e"))
        & (F.col("_s") < F.col("end"))
        & (F.col("_stretch") == F.greatest("_chunk_first", "_first"))
    )
    return touching.groupBy("kb_id", "doc_id", "parent_id").agg(
        F.array_sort(F.collect_list("page_index")).alias("pages")
    )


# --- parents --------------------------------------------------------------------------------


def _as_parents(documents: DataFrame, pieces: Column) -> DataFrame:
    """`pieces`: array<struct<start, content>> of each document, in order. The text itself is not carried on."""
    placed = documents.select("kb_id", "doc_id", "source", F.posexplode(pieces).alias("seq", "_piece"))
    return placed.select(
        "kb_id",
        "doc_id",
        "source",
        stable_id("p", F.col("kb_id"), F.col("doc_id"), F.col("seq")).alias("parent_id"),
        "seq",
        F.col("_piece.start").alias("start"),
        F.col("_piece.content").alias("content"),
    )


def chunk_fixed(documents: DataFrame, size: int = PARENT_SIZE) -> DataFrame:
    """Cut every `size` characters, wherever that lands."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    pieces = F.transform(cut, lambda t, i: F.struct((i * size).cast("int").alias("start"), t.alias("content")))
    return _as_parents(documents.where(F.length("text") > 0), pieces)


def _as_pieces(found: list[list[tuple[int, str]] | None]) -> pa.Array:
    """Lists of (start, content) as one Arrow array; None stays null."""
    sizes = [len(x) if x is not None else 0 for x in found]
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    flat = [piece for x in found if x is not None for piece in x]
    parts = pa.StructArray.from_arrays(
        [pa.array([s for s, _ in flat], pa.int32()), pa.array([t for _, t in flat], pa.string())], names=["start", "content"]
    )
    return pa.ListArray.from_arrays(offsets, parts, mask=pa.array([x is None for x in found]))


def _piece_udf(size: int, overlap: int, breaks: Sequence[str]):
    @F.arrow_udf(PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        return _as_pieces([
            None if t is None else [(s, t[s:e]) for s, e in split_spans(t, size, overlap, breaks)] for t in texts.to_pylist()
        ])

    return pieces


def chunk_recursive(documents: DataFrame, size: int = PARENT_SIZE) -> DataFrame:
    """Cut at blank lines, else at lines, else at spaces; inside a word only as a last resort."""
    return _as_parents(documents, _piece_udf(size, 0, TEXT_BREAKS)(F.col("text")))


def semantic_sentences(documents: DataFrame) -> DataFrame:
    """One row per sentence, with the neighbourhood that is embedded for it.

    A piece keeps the whitespace before it, so piece lengths add up to places in the text. Sentences
    are rows from the start: their ends are a running sum, their neighbours a window.
    """
    cut = documents.where(F.length(strip(F.col("text"))) > 0)
    rows = cut.select("kb_id", "doc_id", F.posexplode(F.split("text", r"(?U)(?<=[.?!])(?=\s)")).alias("pos", "_piece"))
    sized = rows.withColumn("sentence", strip(F.col("_piece"))).withColumn("_step", F.length("_piece").cast("long")).drop("_piece")
    placed = Ordered(sized, ["kb_id", "doc_id"], ["pos"]).total("_step", "_through")
    near = Window.partitionBy("kb_id", "doc_id").orderBy("pos")
    context = F.concat_ws(" ", F.lag("sentence").over(near), F.col("sentence"), F.lead("sentence").over(near))
    return placed.done().select("kb_id", "doc_id", "pos", "sentence", context.alias("context"), F.col("_through").cast("int").alias("end"))


def semantic_breaks(embedded: DataFrame, percentile: float = 95.0) -> DataFrame:
    """Mark the sentences after which the topic shifts.

    `embedded` is semantic_sentences plus `embedding` of the context. The distance to the next
    sentence is rounded to 6 places, so the cut does not hang on the order of additions. The
    windows run per document, and a document is at most one text.
    """
    document = Window.partitionBy("kb_id", "doc_id")
    paired = embedded.withColumn("_after", F.lead("embedding").over(document.orderBy("pos")))
    paired = paired.withColumn("_followed", F.col("_after").isNotNull()).withColumn("_similar", cosines(F.col("embedding"), F.col("_after")))
    distance = F.when(F.col("_followed"), F.round(1 - F.coalesce("_similar", F.lit(0.0)), 6))
    marked = paired.withColumn("distance", distance).drop("_followed", "_similar", "_after", "embedding", "context")
    threshold = F.round(F.percentile("distance", F.lit(percentile / 100)).over(document), 6)
    return (
        marked.withColumn("threshold", threshold)
        .withColumn("is_break", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)))
    )


def chunk_semantic(
    documents: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    min_size: int = MIN_PARENT_SIZE,
    max_size: int = PARENT_SIZE,
    percentile: float = 95.0,
) -> DataFrame:
    """Parents that end where the topic shifts; short ones run on, long ones are cut again.

    `embed` adds an `embedding` column for `context`, for example hooks.embedded(...).
    """
    return semantic_parents(documents, embed(semantic_sentences(documents)), min_size, max_size, percentile)


def semantic_parents(
    documents: DataFrame, embedded: DataFrame, min_size: int = MIN_PARENT_SIZE, max_size: int = PARENT_SIZE, percentile: float = 95.0
) -> DataFrame:
    """chunk_semantic from sentences that have their embedding. Only the ends of breaks are gathered per document."""
    breaks = semantic_breaks(embedded, percentile)
    ends = breaks.groupBy("kb_id", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("is_break"), F.col("end")))).alias("_ends"))

    def pieces(text: str, ends: list[int]) -> Iterator[tuple[int, str]]:
        begun = 0
        for end in [*ends, len(text)]:
            if end < len(text) and end - begun < min_size:
                continue
            body = text[begun:end]
            for s, e in split_spans(body, max_size, 0, SENTENCE_BREAKS):
                yield begun + s, body[s:e]
            begun = end

    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array, marks: pa.Array) -> pa.Array:
        return _as_pieces([list(pieces(t, m)) for t, m in zip(texts.to_pylist(), marks.to_pylist())])

    return _as_parents(documents.join(ends, ["kb_id", "doc_id"]), cut(F.col("text"), F.col("_ends")))


# --- children -------------------------------------------------------------------------------


def child_texts(content: Column, size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> Column:
    """Overlapping pieces of one parent. Text without tags needs no Python: it has no break the
    child splitter looks for, so the pieces are plain windows."""
    stride = size - overlap
    last = F.greatest(F.ceil((F.length(content) - size) / stride), F.lit(0)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: strip(F.substring(content, i * stride + 1, F.lit(size))),
    )
    tagged = _piece_udf(size, overlap, TAG_BREAKS)(F.when(F.contains(content, F.lit("<")), content))
    return F.filter(F.coalesce(tagged["content"], windows), lambda t: F.length(t) > 0)


def chunk_children(parents: DataFrame, size: int = CHILD_SIZE, overlap: int = CHILD_OVERLAP) -> DataFrame:
    placed = parents.withColumn("_texts", child_texts(F.col("content"), size, overlap)).select(
        "kb_id", "doc_id", "source", "parent_id", F.posexplode("_texts").alias("seq", "content")
    )
    return placed.select(
        "kb_id",
        "doc_id",
        "source",
        "parent_id",
        stable_id("c", F.col("parent_id"), F.col("seq")).alias("child_id"),
        "seq",
        "content",
    )


def parent_as_child(parents: DataFrame, children: DataFrame) -> DataFrame:
    """The children plus each parent's whole text as one more child, numbered -1."""
    whole = parents.select(
        "kb_id",
        "doc_id",
        "source",
        "parent_id",
        stable_id("c", F.col("parent_id"), F.lit(-1)).alias("child_id"),
        F.lit(-1).alias("seq"),
        "content",
    )
    return children.unionByName(whole)


def chunk_counts(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Chunks written per document and level."""
    tagged = parents.select("kb_id", "doc_id", F.lit("parent").alias("level")).unionByName(
        children.select("kb_id", "doc_id", F.lit("child").alias("level"))
    )
    return tagged.groupBy("kb_id", "doc_id", "level").agg(F.count("*").alias("chunks"))


# --- back to one text -----------------------------------------------------------------------


def reassemble(chunks: DataFrame) -> DataFrame:
    """Ordered chunks of a document back to one text, overlaps dropped.

    `chunks` has kb_id, doc_id, seq, content; seq may be of any type that sorts, a struct of several
    numbers too. Gives kb_id, doc_id, text and ranges(seq, start, end). A chunk's overlap is looked
    for in as many of the last characters as it has itself, in time proportional to them.
    """
    kinds = {c: chunks.schema[c].dataType for c in ("kb_id", "doc_id", "seq")}
    ordered = chunks.groupBy("kb_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("content")))).alias("_chunks"))
    schema = T.StructType().add("kb_id", kinds["kb_id"]).add("doc_id", kinds["doc_id"]).add("text", T.StringType())
    place = T.StructType().add("seq", kinds["seq"]).add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = schema.add("ranges", T.ArrayType(place))
    arrow = to_arrow_schema(schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("_chunks")
            flat = held.flatten()
            contents, sizes = flat.field("content").to_pylist(), pc.list_value_length(held).to_pylist()
            texts, starts, ends, first = [], [], [], 0
            for n in sizes:
                text, spans = joined(contents[first : first + n])
                texts.append(text)
                starts.extend(s for s, _ in spans)
                ends.extend(e for _, e in spans)
                first += n
            kind = arrow.field("ranges").type.value_type
            places = pa.StructArray.from_arrays([flat.field("seq").cast(kind.field("seq").type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(kind))
            ranges = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), places)
            yield pa.RecordBatch.from_arrays([batch.column("kb_id"), batch.column("doc_id"), pa.array(texts, pa.string()), ranges], names=arrow.names)

    return ordered.mapInArrow(join, schema)
