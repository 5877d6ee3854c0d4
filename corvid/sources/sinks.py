"""Writing chunk stores: a vector collection and a text index, as Parquet tables, each with its statistics row."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.text import strip
from corvid.operators.keyword import postings
from corvid.session import prepare, stage

CONTENT_LIMIT = 65_000
MIN_CHUNK = 10
#: Bytes of JSON the older insert flushes at.
BULK_BYTES = 2 << 20
INDEXED = "text string, file_path string, chunk_index int, source string"


@dataclass
class StorageResult:
    success: bool
    stored_count: int = 0
    error_count: int = 0
    errors: list[str] = field(default_factory=list)


def prepared(chunks: DataFrame, documents: DataFrame | None = None, requires_embedding: bool = False, path: str = "relative_path") -> DataFrame:
    """Rows to store: chunks whose content has ten characters or more, with an embedding if required, doc_id filled from path and
    index. Only if there is no chunk at all, whole documents with id 'path#0'."""
    ok = chunks.where(F.coalesce(F.length(strip("content")) >= MIN_CHUNK, F.lit(False)))
    if requires_embedding:
        ok = ok.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    ok = ok.withColumn("doc_id", F.coalesce("doc_id", F.concat_ws("#", F.coalesce(path, F.lit("")), F.coalesce("chunk_index", F.lit(0)).cast("string"))))
    if documents is None or requires_embedding or not chunks.isEmpty():
        return ok
    whole = documents.select(F.concat(F.coalesce(path, F.lit("")), F.lit("#0")).alias("doc_id"), "content", F.lit(0).alias("chunk_index"), path)
    return whole.where(F.length(strip("content")) >= MIN_CHUNK)


def vector_rows(rows: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) for the vector collection: rows need id, content and embedding; content is cut to 65,000 characters."""
    ok = F.col(id_col).isNotNull() & F.coalesce(F.col("content") != "", F.lit(False)) & F.coalesce(F.size("embedding") > 0, F.lit(False))
    return rows.where(ok).withColumn("content", F.substring("content", 1, CONTENT_LIMIT)), rows.where(~ok)


def upsert_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (ties by the other columns): what an index keyed by id holds after bulk writes."""
    rest = [c for c in rows.columns if c != key and c not in order]
    x = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return x.select(*[F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in rows.columns])


def write(rows: DataFrame, at: str, mode: str = "overwrite", partition_by: list[str] | None = None, max_records: int | None = None) -> None:
    w = rows.write.mode(mode)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(at)


class VectorStore:
    """A collection of embedded chunks. ``overwrite`` (the default) replaces it, else rows are added. ``sparse`` also keeps the
    postings of the texts beside it, at ``at`` + '-sparse'."""

    requires_embedding = True

    def __init__(self, spark: SparkSession, at: str, overwrite: bool = True, sparse: bool = False):
        self.spark, self.at, self.overwrite, self.sparse = spark, at, overwrite, sparse

    def store(self, rows: DataFrame, staged: bool = False) -> StorageResult:
        """Writes the complete rows and counts the others; ``staged`` says that reading ``rows`` again is cheap."""
        rows = rows if staged else stage(rows, "store")
        good, bad = vector_rows(rows)
        mode = "overwrite" if self.overwrite else "append"
        write(good, self.at, mode)
        if self.sparse:
            write(postings(good, "doc_id", "content"), self.at + "-sparse", mode)
        n, n_bad = rows.count(), bad.count()
        return StorageResult(n_bad == 0, n - n_bad, n_bad, [f"{n_bad} rows lack id, content or embedding"] if n_bad else [])

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.at)

    def delete(self, ids: DataFrame) -> int:
        """Remove ids (doc_id); returns how many were asked for. The rest is staged before it replaces the table."""
        rest = stage(self.read().join(ids.select("doc_id").distinct(), "doc_id", "left_anti"), "rest")
        write(rest, self.at)
        return ids.count()

    def stats(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"))


class TextIndex:
    """Chunk texts keyed by doc_id, in ``parts`` partitions by the id's hash; storing again replaces the same ids and rewrites only
    the partitions that new rows fall into. With vectors if any row has one: then rows without count as errors."""

    requires_embedding = False

    def __init__(self, spark: SparkSession, at: str, overwrite: bool = False, parts: int = 64):
        self.spark, self.at, self.overwrite, self.parts = spark, at, overwrite, parts

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ensure(self) -> bool:
        """Make the empty index if there is none; True if it was made."""
        if self.exists():
            return False
        write(self.spark.createDataFrame([], f"doc_id string, {INDEXED}"), self.at)
        return True

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")

    def store(self, rows: DataFrame, staged: bool = False) -> StorageResult:
        rows = rows.withColumnRenamed("content", "text") if "text" not in rows.columns else rows
        for c, kind in (x.split() for x in INDEXED.split(", ")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        rows = rows.withColumn("source", F.coalesce("source", F.lit("")))
        rows = rows.select("doc_id", *[x.split()[0] for x in INDEXED.split(", ")], *(["embedding"] if "embedding" in rows.columns else []))
        rows = rows if staged else stage(rows, "index")
        vectors = "embedding" in rows.columns and not rows.where("embedding IS NOT NULL").isEmpty()
        rows = rows if vectors or "embedding" not in rows.columns else rows.drop("embedding")
        good = rows.where("doc_id IS NOT NULL" + (" AND embedding IS NOT NULL" if vectors else ""))
        n, n_good = rows.count(), good.count()
        new = good.withColumn("part", self._part()).withColumn("_new", F.lit(1))
        old = self.spark.read.parquet(self.at) if self.exists() and not self.overwrite else None
        if old is not None and "part" in old.columns:
            touched = [r["part"] for r in new.select("part").distinct().collect()]
            new = old.where(F.col("part").isin(touched)).withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
        full = stage(upsert_rows(new, "doc_id", ["_new"]).drop("_new"), "upsert")
        dynamic = "dynamic" if old is not None and "part" in old.columns else "static"
        full.write.mode("overwrite").option("partitionOverwriteMode", dynamic).partitionBy("part").parquet(self.at)
        return StorageResult(n == n_good, n_good, n - n_good, [f"{n - n_good} rows rejected"] if n > n_good else [])

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.at).drop("part")

    def stats(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("doc_count"))


class UnitOfWork:
    """Tables that change together: ``write`` stages new versions, ``commit`` makes all of them current by replacing one manifest,
    ``rollback`` (and leaving a ``with`` block by an exception) forgets them. Readers see the last committed manifest only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.pending = spark, root.rstrip("/"), {}
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _manifest(self) -> dict[str, str]:
        at = self._path("_current/manifest")
        return json.loads(self.spark.read.text(f"{self.root}/_current/manifest", wholetext=True).first()[0]) if self.fs.exists(at) else {}

    def write(self, name: str, rows: DataFrame) -> None:
        at = f"{name}-{uuid.uuid4().hex}"
        write(rows, f"{self.root}/{at}")
        self.pending[name] = at

    def read(self, name: str) -> DataFrame:
        """The table as this unit sees it: its own pending version, else the committed one; KeyError for an unknown name."""
        return self.spark.read.parquet(f"{self.root}/{(self._manifest() | self.pending)[name]}")

    def commit(self) -> None:
        text = json.dumps(self._manifest() | self.pending)
        new = f"_new-{uuid.uuid4().hex}"
        out = self.fs.create(self._path(f"{new}/manifest"))
        out.write(bytearray(text, "utf-8"))
        out.close()
        old = self._path(f"_old-{uuid.uuid4().hex}")
        if self.fs.exists(self._path("_current")):
            self.fs.rename(self._path("_current"), old)
        if not self.fs.rename(self._path(new), self._path("_current")):
            raise RuntimeError("the manifest could not be replaced")
        self.fs.delete(old, True)
        self.pending = {}

    def rollback(self) -> None:
        for at in self.pending.values():
            self.fs.delete(self._path(at), True)
        self.pending = {}

    def __enter__(self) -> UnitOfWork:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()


def write_tree(df: DataFrame, path: str, text: str, root: str, suffix: str | None = None) -> DataFrame:
    """(path, error): each text as a file of its own below ``root``, at its relative path (with ``suffix`` in place of the last one);
    error is null where it was written. Files are written by the tasks and moved into place, so a repeated task does no harm.
    Null texts are written empty, null paths and those that lead out of ``root`` are errors. Runs when the result is read."""
    prepare(df.sparkSession)
    base = root if "://" in root else "file://" + root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(base)
        for b in batches:
            errors = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    if not p or p.startswith("/") or ".." in p.split("/"):
                        raise ValueError("not a path below the root")
                    name = (p.rsplit(".", 1)[0] if "." in p.rsplit("/", 1)[-1] else p) + suffix if suffix else p
                    at = f"{top}/{name}"
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    held = f"{at.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                    with fs.open_output_stream(held) as out:
                        out.write((t or "").encode("utf-8", "replace"))
                    fs.move(held, at)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string())], ["path", "error"])

    return df.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text")).mapInArrow(run, "path string, error string")


def write_code(blocks: DataFrame, root: str) -> DataFrame:
    """(code_id) of the blocks written, one .txt file each: those that could not be written are not to be replaced."""
    return write_tree(blocks.groupBy("code_id").agg(F.min("code").alias("code")).withColumn("_path", F.concat("code_id", F.lit(".txt"))), "_path", "code", root).where("error IS NULL").select(F.regexp_replace("path", r"\.txt$", "").alias("code_id"))


def append_rows(rows: DataFrame, at: str, required: list[str], max_bytes: int = BULK_BYTES) -> int:
    """The older bulk insert: incomplete rows are skipped without a word, the rest is appended in files of about ``max_bytes`` of
    JSON at most; a re-run duplicates."""
    ok: Column = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    good = stage(rows.where(ok), "bulk")
    n, size = good.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length(F.to_json(F.struct(*good.columns)))), F.lit(1))).first()
    write(good, at, "append", max_records=max(1, max_bytes // size))
    return n


BACKENDS = {"vector": VectorStore, "text": TextIndex}


def create_backend(name: str, spark: SparkSession, at: str, **options):
    """The backend of that name; ValueError for any other."""
    if name not in BACKENDS:
        raise ValueError(f"unknown storage backend: {name}")
    return BACKENDS[name](spark, at, **options)
