"""A stored index: versions, tombstones and signed term statistics, merged when it is opened.

Folder layout::

    versions/<number>.json   one manifest per commit; the highest number is current
    <table>/<segment>/       rows one commit added: parents, children, terms, token_vectors, dense-<n>,
                             and failed, the files that could not be indexed
    gone/<segment>/          (kb_id, doc_id) of files that a commit replaced or deleted
    counts/<segment>/        (kb_id, term, df) and, with a null term, children, as signed changes

`put` writes the rows of the files it is given and marks the same files gone for all commits before
it; `delete` only marks. `build` makes the tables in place. None reads or writes rows of other files: of
the stored terms they look at the files concerned, to take their counts off, and rows are stored in order
of file (by `build` the tables made of parents within each part), so that only what may hold them is
read. `open` reads the segments of a manifest and hides rows older than the mark of their file;
statistics are the sums of all changes. `compact` writes what is live as one segment.

A commit is one rename of a manifest, which fails if another writer took the number; the loser takes
the next one and counts again. Readers see a whole version or the one before. A commit may carry a
writer's name and batch number: numbers up to the last one committed are skipped, so a batch that
runs twice counts once. Segments that no manifest names are left-overs of failed commits.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Collection
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import KbConfig
from tidemark.functions.text import tokenize
from tidemark.operators.index import rarity
from tidemark.plans.corpus import ERROR, Corpus, build_corpus
from tidemark.plans.skew import materialize

FEW_FILES = 1000  # ids of so few files are also pushed into the scan
FILE = ["kb_id", "doc_id"]


@dataclass(frozen=True)
class Version:
    """What an index consists of. `segments`, `gone` and `counts` hold (folder name, commit number)."""

    number: int = 0
    models: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    segments: tuple[tuple[str, int], ...] = ()
    gone: tuple[tuple[str, int], ...] = ()
    counts: tuple[tuple[str, int], ...] = ()
    batches: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def read(text: str) -> Version:
        held = json.loads(text)
        pairs = {k: tuple((name, at) for name, at in held[k]) for k in ("segments", "gone", "counts")}
        return Version(**{**held, **pairs, "models": tuple(held["models"]), "tables": tuple(held["tables"])})


class Folder:
    """The few file operations a commit needs, on any filesystem Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        hadoop = self.jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self.to = hadoop.Path
        self.files = self.to(self.path).getFileSystem(conf)
        self.context = hadoop.FileContext.getFileContext(self.files.getUri(), conf)
        self.none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)

    def names(self, name: str) -> list[str]:
        path = self.to(posixpath.join(self.path, name))
        return [s.getPath().getName() for s in self.files.listStatus(path)] if self.files.exists(path) else []

    def text(self, name: str) -> str:
        stream = self.files.open(self.to(posixpath.join(self.path, name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole file under a name nobody has taken; False if somebody has."""
        target = self.to(posixpath.join(self.path, name))
        scratch = self.to(posixpath.join(self.path, posixpath.dirname(name), f".{uuid.uuid4().hex}"))
        stream = self.files.create(scratch, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self.context.rename(scratch, target, self.none)
            return True
        except Exception as failure:
            self.files.delete(scratch, False)
            if "FileAlreadyExists" not in str(failure):
                raise
            return False


class Index:
    """A stored index of any number of bases."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    # --- versions ---

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("versions") if n.endswith(".json") and n[0] != ".")

    def version(self, number: int | None = None) -> Version:
        number = max(self.versions(), default=0) if number is None else number
        return Version.read(self.folder.text(f"versions/{number:012d}.json")) if number else Version()

    def _commit(self, change: Callable[[Version], Version], batch: tuple[str, int] | None) -> int:
        while True:
            old = self.version()
            if batch and old.batches.get(batch[0], -1) >= batch[1]:
                return old.number
            new = replace(change(old), number=old.number + 1)
            if batch:
                new = replace(new, batches={**new.batches, batch[0]: batch[1]})
            if self.folder.create(f"versions/{new.number:012d}.json", json.dumps(asdict(new))):
                return new.number

    # --- writing ---

    def _where(self, table: str, segment: str) -> str:
        return f"{self.path}/{table}/{segment}"

    def _write(self, rows: DataFrame, table: str, segment: str, ordered: bool = False) -> None:
        """In order of file, so that a scan for few files skips most of it; `ordered` rows are so already."""
        order = [c for c in FILE if c in rows.columns]
        rows = rows if ordered else rows.repartitionByRange(*order).sortWithinPartitions(*order)
        rows.write.mode("overwrite").option("compression", "zstd").parquet(self._where(table, segment))

    def build(
        self,
        documents: DataFrame,
        config: KbConfig = KbConfig(),
        embedders: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
        tokens: Callable[[Column], Column] = tokenize,
        files: DataFrame | None = None,
        batch: tuple[str, int] | None = None,
    ) -> int:
        """`put` of what `build_corpus` makes of documents, whose tables are written here at once.

        Parents are put in order of file; all other tables are made of theirs within tasks and keep
        that order, so nothing else is shuffled and no table is written twice. If some files failed,
        their rows must go again, and the tables are stored as by `put`.
        """
        if batch and self.version().batches.get(batch[0], -1) >= batch[1]:
            return self.version().number
        segment, written = uuid.uuid4().hex, set()

        def keep(rows: DataFrame, name: str) -> DataFrame:
            if name == "idf":
                return rows  # summed up from the counts when the index is opened
            if ERROR in rows.columns or name == "token_vectors":
                return materialize(rows, name, "zstd")
            self._write(rows, name, segment, ordered=name != "parents")
            written.add(name)
            return self.spark.read.schema(rows.schema).parquet(self._where(name, segment))

        corpus = build_corpus(documents, config, embedders, tokens, keep)
        if corpus.failed is not None and corpus.failed.head(1):
            return self.put(corpus, files, batch)
        return self.put(corpus, files, batch, segment, written)

    def put(
        self,
        corpus: Corpus,
        files: DataFrame | None = None,
        batch: tuple[str, int] | None = None,
        segment: str | None = None,
        written: Collection[str] = (),
    ) -> int:
        """Add the rows of `corpus`, in place of what is stored of files(kb_id, doc_id); gives the version.

        Without `files`, those that have parents. A file listed without any rows is removed. All
        tables must belong to the same files; `batch` = (writer, number) makes repeats harmless.
        The tables `written` lie in `segment` already, see `build`.
        """
        if batch and self.version().batches.get(batch[0], -1) >= batch[1]:
            return self.version().number
        segment = segment or uuid.uuid4().hex
        tables = self._tables(corpus)
        for name, rows in tables.items():
            if name not in written:
                self._write(rows, name, segment)
        files = corpus.parents if files is None else files
        self._write(files.select(*FILE).distinct(), "gone", segment)
        added = self._read("terms", [(segment, 0)]).drop("_commit") if "terms" in tables else None

        def change(old: Version) -> Version:
            models, held = tuple(sorted(corpus.dense)), tuple(sorted(tables))
            if old.segments and (models, held) != (old.models, old.tables):
                raise ValueError(f"the index holds {old.tables} of {old.models}, these are {held} of {models}")
            counted = self._count(old, segment, added)
            at = old.number + 1
            return replace(
                old, models=models, tables=held, segments=(*old.segments, (segment, at)), gone=(*old.gone, (segment, at)), counts=(*old.counts, (counted, at))
            )

        return self._commit(change, batch)

    def delete(self, files: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Hide all rows of files(kb_id, doc_id); nothing happens to files that are not there."""
        segment = uuid.uuid4().hex
        self._write(files.select(*FILE).distinct(), "gone", segment)

        def change(old: Version) -> Version:
            at = old.number + 1
            return replace(old, gone=(*old.gone, (segment, at)), counts=(*old.counts, (self._count(old, segment, None), at)))

        return self._commit(change, batch)

    def _count(self, old: Version, gone: str, added: DataFrame | None) -> str:
        """Write the signed changes to the term statistics when files go and rows come."""
        parts = []
        if "terms" in old.tables and old.segments:
            files = self.spark.read.parquet(self._where("gone", gone))
            parts.append((self._live("terms", old, files), -1))
        if added is not None:
            parts.append((added, 1))
        changes = self.spark.createDataFrame([], "kb_id string, term string, df long")
        for rows, sign in parts:
            per_term = rows.select("kb_id", F.explode("terms").alias("term"), F.lit(sign).cast("long").alias("df"))
            changes = changes.unionByName(per_term).unionByName(rows.select("kb_id", F.lit(None).cast("string").alias("term"), F.lit(sign).cast("long").alias("df")))
        segment = uuid.uuid4().hex
        summed = changes.groupBy("kb_id", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        summed.write.mode("overwrite").option("compression", "zstd").parquet(self._where("counts", segment))
        return segment

    def compact(self) -> int:
        """Write all live rows as one segment without marks. Older versions stay readable."""

        def change(old: Version) -> Version:
            segment, at = uuid.uuid4().hex, old.number + 1
            for table in old.tables:
                self._write(self._live(table, old), table, segment)
            self._folded(old).write.mode("overwrite").option("compression", "zstd").parquet(self._where("counts", segment))
            return replace(old, segments=((segment, at),), gone=(), counts=((segment, at),))

        return self._commit(change, None)

    # --- reading ---

    def _tables(self, corpus: Corpus) -> dict[str, DataFrame]:
        held = {"parents": corpus.parents, "children": corpus.children, "terms": corpus.terms, "token_vectors": corpus.tokens}
        tables = {name: rows for name, rows in held.items() if rows is not None}
        nothing = corpus.parents.where("false").select(*FILE, F.lit("").alias("stage"), F.lit("").alias("error"))
        tables["failed"] = nothing if corpus.failed is None else corpus.failed.select(*nothing.columns)
        owners = corpus.children.select("kb_id", "doc_id", "child_id")
        for n, model in enumerate(sorted(corpus.dense)):
            rows = corpus.dense[model]
            tables[f"dense-{n}"] = rows if "doc_id" in rows.columns else rows.join(owners, ["kb_id", "child_id"])
        if "token_vectors" in tables and "doc_id" not in tables["token_vectors"].columns:
            chunks = corpus.parents.select(*FILE, F.col("parent_id").alias("chunk_id")).unionByName(corpus.children.select(*FILE, F.col("child_id").alias("chunk_id")))
            tables["token_vectors"] = tables["token_vectors"].join(chunks, ["kb_id", "chunk_id"])
        return tables

    def _read(self, table: str, segments) -> DataFrame:
        """Rows of some segments with the number of the commit they came with."""
        by_commit = [self.spark.read.parquet(self._where(table, s)).withColumn("_commit", F.lit(at)) for s, at in segments]
        rows = by_commit[0]
        for more in by_commit[1:]:
            rows = rows.unionByName(more)
        return rows

    def _live(self, table: str, version: Version, files: DataFrame | None = None) -> DataFrame:
        """Rows that no later commit has marked; with `files`, of these alone."""
        last_mark = max((at for _, at in version.gone), default=0)
        untouched = [s for s in version.segments if s[1] >= last_mark]
        marked = [s for s in version.segments if s[1] < last_mark]
        wanted = None
        if files is not None:
            few = files.limit(FEW_FILES + 1).collect()  # bounded
            wanted = (F.col("kb_id").isin({r["kb_id"] for r in few}) & F.col("doc_id").isin([r["doc_id"] for r in few])) if len(few) <= FEW_FILES else F.lit(True)
        parts = []
        for segments in (untouched, marked):
            if not segments:
                continue
            rows = self._read(table, segments)
            if files is not None:
                rows = rows.where(wanted).join(files, FILE, "left_semi")
            if segments is marked:
                # only marks beyond the oldest of these segments matter
                marks = self._read("gone", [g for g in version.gone if g[1] > min(at for _, at in marked)])
                marks = marks.groupBy(*FILE).agg(F.max("_commit").alias("_gone"))
                rows = rows.join(marks, FILE, "left").where("_gone IS NULL OR _commit >= _gone").drop("_gone")
            parts.append(rows.drop("_commit"))
        rows = parts[0]
        return rows.unionByName(parts[1]) if len(parts) > 1 else rows

    def _folded(self, version: Version) -> DataFrame:
        return self._read("counts", version.counts).groupBy("kb_id", "term").agg(F.sum("df").alias("df")).where("df <> 0")

    def term_idf(self, version: Version) -> DataFrame:
        """As index.term_idf of all live rows, from the sums of changes alone."""
        counts = materialize(self._folded(version), "term_counts", "zstd")
        sizes = counts.where("term IS NULL").select("kb_id", F.col("df").alias("n_children"))
        held = counts.where("term IS NOT NULL").join(sizes, "kb_id")
        return held.select("kb_id", "term", "df", "n_children", rarity(F.col("n_children"), F.col("df")).alias("idf"))

    def open(self, number: int | None = None) -> Corpus:
        """The index as of a version, the latest by default."""
        version = self.version(number)
        if not version.segments:
            raise ValueError(f"nothing is stored in {self.path}")
        live = {table: self._live(table, version) for table in version.tables}
        idf = materialize(self.term_idf(version), "idf", "zstd") if "terms" in live else None
        dense = {model: live[f"dense-{n}"] for n, model in enumerate(version.models)}
        return Corpus(live["parents"], live["children"], live.get("terms"), idf, dense, live.get("token_vectors"), live["failed"])
