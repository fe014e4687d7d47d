"""Files in and out: archives, blobs, pages, JSON and result documents."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hooks import outcome
from tidemark.functions.text import strip

ENTRY_BYTES = 4 << 20

# What an operating system leaves in an archive.
JUNK_STARTS = (".", "__MACOSX")
JUNK_NAMES = ("thumbs.db", "desktop.ini")
EVAL_SCHEMA = (
    "id string, question string, question_paraphrase string, answer string, type string, "
    "relevant array<struct<page:int, section:string, gold_text:string>>, source_doc string"
)
CHUNKS_SCHEMA = "filename string, chunks array<struct<seq:int, content:string>>"
PAIRS_SCHEMA = (
    "dataset_id string, source_file string, context string, question string, answer string, "
    "category string, labels array<string>"
)


def is_junk_path(name: Column) -> Column:
    """Folders, hidden files and operating system leftovers."""
    parts = F.split(name, "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(JUNK_STARTS[0])) | F.startswith(p, F.lit(JUNK_STARTS[1])))
    return F.endswith(name, F.lit("/")) | hidden | F.lower(F.element_at(parts, -1)).isin(*JUNK_NAMES)


def strict_text(data: Column) -> Column:
    """Bytes as text, NULL when they are not UTF-8 or carry a NUL."""
    text = F.try_validate_utf8(data.cast("string"))
    return F.when(~F.contains(text, F.lit("\0")), text)


def lenient_text(data: Column) -> Column:
    """Bytes as text, with a replacement character where they are not UTF-8."""
    return F.make_valid_utf8(data.cast("string"))


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, data, error) of every entry of the zip files under `path` that is no junk.

    Archives are read in parallel and their entries given out in batches of about ENTRY_BYTES. A
    broken archive is one row with an error and no name, a broken entry a row with its name.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    schema = pa.schema([("archive", pa.string()), ("name", pa.string()), ("data", pa.binary()), ("error", pa.string())])

    def rows(archive: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as opened:
                for name in opened.namelist():
                    if name.endswith("/"):
                        continue
                    try:
                        yield archive, name, opened.read(name), None
                    except Exception as failure:
                        yield archive, name, None, outcome(failure)
        except Exception as failure:
            yield archive, None, None, outcome(failure)

    def batched(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for row in rows(archive, content.as_py()):
                    held.append(row)
                    size += len(row[2] or b"") + 100
                    if size > ENTRY_BYTES:
                        yield batched(held)
                        held, size = [], 0
        if held:
            yield batched(held)

    raw = found.select("path", "content").mapInArrow(entries, "archive string, name string, data binary, error string")
    return raw.where(F.col("name").isNull() | ~is_junk_path(F.col("name")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, text) of every real text file in the zip files under `path`; what is broken is left out."""
    return scan_archives(spark, path).select("archive", "name", strict_text(F.col("data")).alias("text")).where("text IS NOT NULL")


def broken_entries(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, error) of archives and entries that could not be read."""
    return scan_archives(spark, path).where("error IS NOT NULL").select("archive", "name", "error")


def read_text_files(spark: SparkSession, path: str, kb_id: str) -> DataFrame:
    """Text files as one-page documents: pages(kb_id, doc_id, source, page_index, markdown)."""
    return as_pages(spark.read.format("binaryFile").load(path), kb_id)


def as_pages(files: DataFrame, kb_id: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.lit(kb_id).alias("kb_id"), F.col("path").alias("doc_id"), name.alias("source"),
        F.lit(0).alias("page_index"), lenient_text(F.col("content")).alias("markdown"),
    )


def blank_pages(pages: DataFrame) -> DataFrame:
    """Pages without a text of their own: the work list for reading them from the image."""
    return pages.where(F.length(strip(F.coalesce("markdown", F.lit("")))) == 0)


def merge_page_text(pages: DataFrame, read: DataFrame) -> DataFrame:
    """Keep each page's own text; blank pages take what was read(kb_id, doc_id, page_index, ocr_text).

    `read` may lack kb_id where file ids are unique across bases.
    """
    keys = [c for c in ("kb_id", "doc_id", "page_index") if c in read.columns]
    own = F.when(F.length(strip(F.col("markdown"))) > 0, F.col("markdown"))
    return pages.join(read, keys, "left").withColumn(
        "markdown", F.coalesce(own, "ocr_text")
    ).drop("ocr_text")


def read_eval_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with nested gold passages, one row per question and passage."""
    rows = spark.read.schema(EVAL_SCHEMA).json(path)
    return rows.select(
        "id", "question", "question_paraphrase", "answer", "type", "source_doc", F.inline_outer("relevant")
    )


def read_document_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Document files of the form {filename, chunks: [{seq, content}]} as one row per chunk."""
    rows = spark.read.schema(CHUNKS_SCHEMA).option("multiLine", True).json(path)
    return rows.select("filename", F.inline("chunks"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """QA pairs as JSON, a folder per dataset; writing a dataset again replaces only its own."""
    _replace(pairs, path, "json", "dataset_id")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIRS_SCHEMA).json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Nested result documents as JSON, a folder per run."""
    _replace(results, path, "json", "run_id")


def _replace(df: DataFrame, path: str, kind: str, by: str) -> None:
    """Rebalancing gives small folders one file and splits a folder that holds most rows."""
    (
        df.hint("rebalance", by).write.format(kind).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(by).save(path)
    )


def save_blobs(blobs: DataFrame, root: str) -> int:
    """Store blobs(key, content) as files under `root`, in place of what is there; gives their number.

    A file is written beside its place and then moved, so readers never see a part of it.
    """
    from pyarrow import fs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "", 1))
        for batch in batches:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content")):
                target = f"{base.rstrip('/')}/{key}"
                scratch = f"{target}.{uuid.uuid4().hex}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(scratch) as stream:
                    stream.write(content.as_buffer() if content.is_valid else b"")
                files.move(scratch, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    done = blobs.select("key", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long")
    return done.agg(F.sum("n")).head()[0] or 0


def delete_blobs(spark: SparkSession, root: str, key: str) -> bool:
    """Remove one key, or all keys below it; False if there is nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def load_blob(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The bytes stored under one key, as (path, content)."""
    return spark.read.format("binaryFile").load(f"{root}/{key}").select("path", "content")
