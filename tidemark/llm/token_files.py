"""Token ids in Arrow files of equal-length sequences.

Documents are put in ascending order of their key by a range exchange. Each task encodes its range
and writes one Arrow IPC file: the streaming format between a header and a footer, so that any
batch can be found at once. Columns `tokens` and `mask` are fixed-size lists, so a batch's values
are one block of memory: a memory-mapped file gives sequences without copying or parsing. Ids take
16 bits where the vocabulary allows. Documents follow one another, each with an end id; only the
last sequence of a file is padded, under a false mask. File names carry the task attempt and only
files named in the committed index count, so lost or repeated tasks leave no mark.

Defined results: a null or empty text is the end id alone; null keys come first; rows of equal key
are ordered by a hash of their text, and equal rows are all written; an empty table gives an empty
index. Extra columns are not written.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import small_batches
from tidemark.llm.words import slices
from tidemark.plans.skew import materialize, shared_folder

SEQUENCE = 2048
BATCH_SEQUENCES = 32
CACHED_WORDS = 500_000
GROUP = 64


def word_encoder(load: Callable, dtype: str) -> Callable[[list[bytes]], list[bytes]]:
    """Encodes texts by their words, for tokenizers that treat words between white space on their own.

    Such are those that drop white space before splitting. A distinct word is encoded once as long
    as it is met again in time: about 2 * CACHED_WORDS of the latest stay known to the worker
    process, also between tasks.
    """
    tokenizer = load()
    held = sys.modules.setdefault("_tidemark_word_ids", types.ModuleType("_tidemark_word_ids"))
    # words of late, and those of before that, which move up when met again
    known: list[dict[bytes, bytes]] = held.__dict__.setdefault(f"{load.args}{dtype}", [{}, {}])  # type: ignore[attr-defined]

    def encode_words(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        for i in range(0, len(words), GROUP):
            group = words[i : i + GROUP]
            texts = [w.decode("utf-8") for w in group]
            encoded = tokenizer.encode(" ".join(texts), add_special_tokens=False)
            raw = np.array(encoded.ids, dtype=dtype).tobytes()
            starts = np.array([a for a, _ in encoded.offsets], dtype=np.int64)
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            cut = np.searchsorted(starts, np.cumsum(sizes + 1) - sizes - 1) * np.dtype(dtype).itemsize
            ends = [*cut[1:].tolist(), len(raw)]
            yield from ((w, raw[a:z]) for w, a, z in zip(group, cut.tolist(), ends))

    def encode(texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        late, early = known
        found, missing = {}, []
        for word in set().union(*split):
            ids = late.get(word)
            if ids is None:
                ids = early.get(word)
                if ids is None:
                    missing.append(word)
                    continue
                late[word] = ids
            found[word] = ids
        new = dict(encode_words(missing))
        late.update(new)
        found.update(new)
        if len(late) > CACHED_WORDS:
            known[:] = [{}, late]
        return [b"".join(map(found.__getitem__, words)) for words in split]

    return encode


def text_encoder(load: Callable, dtype: str) -> Callable[[list[bytes]], list[bytes]]:
    """Encodes whole texts, for any tokenizer."""
    tokenizer = load()

    def encode(texts: list[bytes]) -> list[bytes]:
        batch = tokenizer.encode_batch([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype=dtype).tobytes() for e in batch]

    return encode


class Loader:
    """Loads a tokenizer from a file on the machine that runs the task."""

    def __init__(self, path: str):
        self.args = (path,)

    def __call__(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.args[0])


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


def _schema(dtype: str, sequence: int) -> pa.Schema:
    ids = pa.from_numpy_dtype(np.dtype(dtype))
    return pa.schema([("tokens", pa.list_(ids, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class Writer:
    """Packs documents into one file, holding one batch of sequences at most."""

    def __init__(self, uri: str, dtype: str, sequence: int, batch: int):
        filesystem, path = _filesystem(uri)
        self.sink = filesystem.open_output_stream(path)
        self.schema, self.dtype, self.sequence = _schema(dtype, sequence), np.dtype(dtype), sequence
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.buffer, self.full, self.total = bytearray(), batch * sequence * self.dtype.itemsize, 0

    def add(self, ids: bytes) -> tuple[int, int]:
        """Where the document begins in the file, and its number of ids."""
        at, n = self.total, len(ids) // self.dtype.itemsize
        self.total += n
        self.buffer += ids
        while len(self.buffer) >= self.full:
            self._flush(bytes(self.buffer[: self.full]))
            del self.buffer[: self.full]
        return at, n

    def _flush(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, dtype=self.dtype)
        padded = np.zeros(-(-len(ids) // self.sequence) * self.sequence, dtype=self.dtype)
        padded[: len(ids)] = ids
        values = [pa.array(padded), pa.array(np.arange(len(padded)) < len(ids))]
        arrays = [pa.FixedSizeListArray.from_arrays(v, self.sequence) for v in values]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.buffer:
            self._flush(bytes(self.buffer))
        self.file.close()
        self.sink.close()


class Reader:
    """Random access to a token file. Local files are memory-mapped and nothing is copied."""

    def __init__(self, uri: str):
        filesystem, path = _filesystem(uri)
        self.source = pa.memory_map(path) if filesystem.type_name == "local" else filesystem.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("tokens").type.list_size
        self.batch = len(self.file.get_batch(0)) if self.file.num_record_batches else 1

    def tokens(self, number: int) -> np.ndarray:
        """Ids of all sequences of a batch, one after another."""
        return self.file.get_batch(number).column("tokens").values.to_numpy(zero_copy_only=True)

    def sequence_at(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The i-th sequence and its mask."""
        batch = self.file.get_batch(i // self.batch)
        row = i % self.batch
        values = batch.column("tokens").values.to_numpy(zero_copy_only=True)
        return values[row * self.sequence : (row + 1) * self.sequence], batch.column("mask")[row].values

    def span(self, at: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `at` on, in pieces as they lie in the file."""
        per_batch = self.batch * self.sequence
        while n > 0:
            values = self.tokens(at // per_batch)
            piece = values[at % per_batch : at % per_batch + n]
            yield piece
            at, n = at + len(piece), n - len(piece)


def write(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    by_words: bool = True,
    dtype: str = "<u2",
    sequence: int = SEQUENCE,
    batch: int = BATCH_SEQUENCES,
) -> DataFrame:
    """Writes token files into `folder` and returns the index: shard, path, id, at, n_tokens per row.

    `at` counts ids within the file. `tokenizer` is a file that the executors can open.
    """

    def run(batches):
        encode = (word_encoder if by_words else text_encoder)(Loader(tokenizer), dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        task = TaskContext.get()
        shard, uri = task.partitionId(), f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        writer = None
        for part in (p for b in batches for p in slices(b, "text", 1 << 21)):
            writer = writer or Writer(uri, dtype, sequence, batch)
            texts = [t or b"" for t in part.column("text").cast(pa.large_binary()).to_pylist()]
            placed = [writer.add(ids + end) for ids in encode(texts)]
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array([uri] * n), part.column("id"),
                 pa.array([a for a, _ in placed], pa.int64()), pa.array([c for _, c in placed], pa.int64())],
                names=["shard", "path", "id", "at", "n_tokens"],
            )
        if writer:
            writer.close()

    small_batches(docs.sparkSession)
    filesystem, path = _filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    held = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    order = [F.asc_nulls_first("id"), F.asc(F.xxhash64("text"))]
    ordered = held.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType().add("shard", T.IntegerType()).add("path", T.StringType()).add(held.schema["id"]).add("at", T.LongType()).add("n_tokens", T.LongType())
    return materialize(ordered.mapInArrow(run, schema), "token_index")


def read(index: DataFrame) -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))  # a row per file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = index.join(totals, "shard").select("path", "id", "at", "n_tokens", (F.col("_before") + F.col("at")).alias("start"))

    def run(batches):
        path, reader = None, None
        for batch in batches:
            sums = []
            for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "n_tokens"))):
                if name != path:
                    path, reader = name, Reader(name)
                crc = 0
                for piece in reader.span(at, n):
                    crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "start", "n_tokens")] + [pa.array(sums, pa.int64())],
                names=["id", "start", "n_tokens", "ids_crc32"],
            )

    schema = T.StructType().add(index.schema["id"]).add("start", T.LongType()).add("n_tokens", T.LongType()).add("ids_crc32", T.LongType())
    return placed.mapInArrow(run, schema)


def new_folder(spark) -> str:
    """A fresh folder among those all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
