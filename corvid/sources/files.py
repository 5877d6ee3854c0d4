"""Reading documents from folders of files, and the tree of their paths."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.text import excluded_path
from corvid.operators.vectors import embed
from corvid.session import prepare

EXTENSIONS = [".html", ".md", ".txt"]
EXCLUDED = ["_print"]
UPLOADS = [".txt", ".md", ".html", ".pdf", ".docx"]


def described(df: DataFrame, path: Column, root: str) -> DataFrame:
    """Raw documents: file_path, relative_path, file_name, file_type (lower case), file_size in characters, content."""
    base = root.rstrip("/") + "/"
    rel = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(F.substring_index(path, "/", -1))
    name = F.substring_index(path, "/", -1)
    return df.select(
        path.alias("file_path"),
        rel.alias("relative_path"),
        name.alias("file_name"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("file_type"),
        F.length("content").alias("file_size"),
        "content",
    )


def kept_paths(df: DataFrame, extensions: list[str] = EXTENSIONS, exclude: list[str] = EXCLUDED, on: str = "relative_path", any_case: bool = False) -> DataFrame:
    """Documents with one of the extensions, no excluded substring in the path and no hidden file or folder."""
    end = reduce(lambda a, b: a | b, [(F.lower(on) if any_case else F.col(on)).endswith(e) for e in extensions])
    hidden = F.col(on).rlike(r"(^|/)\.")
    return df.where(end & ~excluded_path(on, exclude) & ~hidden)


def _uri(root: str) -> str:
    return root if "://" in root else "file://" + root


def read_documents(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, exclude: list[str] = EXCLUDED, recursive: bool = True, any_case: bool = False, on: str = "relative_path") -> DataFrame:
    """Documents below a folder, one row a file, UTF-8. Unreadable bytes become the replacement character. Files that
    Spark does not list (of no bytes, or with a name or folder that begins with '_') are read beside the others.

    Names are tested before any byte is read: extensions by the reader's glob, excluded substrings by a filter on the file's
    path that prunes the list of files."""
    glob = "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if any_case and c.isalpha() else c for c in e) for e in extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root)
    base = _uri(root).rstrip("/") + "/"
    at = F.col("_metadata.file_path")
    for e in exclude:
        # The metadata's path is URL-encoded: only plain names are tested there, all of them again below.
        if all(c.isalnum() or c in "._-/" for c in e):
            raw = raw.where(~at.startswith(base) | ~F.contains(F.substr(at, F.lit(1 if on == "file_path" else len(base) + 1)), F.lit(e)))
    full = raw.select("path", F.col("content").cast("string").alias("content"))
    missed = _unlisted(spark, root, recursive, extensions, any_case, exclude if on == "relative_path" else [])
    if missed:
        full = full.unionByName(_read_each(spark.createDataFrame([(p,) for p in missed], "path string")))
    path = F.regexp_replace("path", "^file:/+", "/")
    return kept_paths(described(full, path, root.removeprefix("file://")), extensions, exclude, on, any_case)


def _unlisted(spark: SparkSession, root: str, recursive: bool, extensions: list[str], any_case: bool, exclude: list[str]) -> list[str]:
    """Paths of the files that Spark's reader leaves out; the driver lists the folder, as that reader does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    it = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, recursive)
    base, out = root.split("://")[-1].rstrip("/") + "/", []
    while it.hasNext():
        f = it.next()
        rel = f.getPath().toUri().getPath().removeprefix(base)
        hidden = any(x.startswith("_") and "=" not in x for x in rel.split("/"))
        if (hidden or not f.getLen()) and (rel.lower() if any_case else rel).endswith(tuple(extensions)) and not any(e in rel for e in exclude):
            out.append(f.getPath().toString())
    return out


def _read_each(paths: DataFrame) -> DataFrame:
    """(path, content) of files by name, read by the tasks."""
    prepare(paths.sparkSession)

    def run(batches):
        for b in batches:
            texts = []
            for p in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                with fs.open_input_stream(at) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["path", "content"])

    return paths.mapInArrow(run, "path string, content string")


def read_legacy(spark: SparkSession, root: str) -> DataFrame:
    """The older walk: .html of any case, '_print' tested on the full path."""
    return read_documents(spark, root, [".html"], ["_print"], any_case=True, on="file_path")


def read_for_markdown(spark: SparkSession, root: str) -> DataFrame:
    """The markdown loader's walk: only _print/index.html is left out."""
    return read_documents(spark, root, [".html"], ["_print/index.html"])


def read_one(spark: SparkSession, path: str) -> DataFrame:
    """A single file as a document."""
    return described(spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("content")), F.regexp_replace("path", "^file:/+", "/"), path.rpartition("/")[0].removeprefix("file://"))


def uploads(spark: SparkSession, root: str) -> DataFrame:
    """Uploaded files of the allowed types, by the last suffix in lower case; one document each, never cut."""
    return read_documents(spark, root, UPLOADS, [], any_case=True)


def upload_vectors(docs: DataFrame, path: str = "relative_path", text: str = "content", **encoder) -> DataFrame:
    """``docs`` of an allowed type with one vector for each whole file: the columns, embedding and error."""
    ok = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(UPLOADS)
    return embed(docs.where(ok), path, text, keep=True, **encoder)


def unique_paths(docs: DataFrame, path: str, key: str) -> DataFrame:
    """``docs`` with paths that name one row each, so none is lost: of rows with equal paths the one of the smallest key keeps it,
    the others become 'path@key'; null and empty paths become 'page_key'."""
    named = docs.where(F.coalesce(F.col(path) != "", F.lit(False)))
    shared = named.groupBy(path).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first")).where("_n > 1").select(path, "_first")
    k = F.col(key).cast("string")
    full = docs.join(shared, path, "left")
    name = F.when(F.coalesce(F.col(path) == "", F.lit(True)), F.concat(F.lit("page_"), k)).when(F.col("_first") != F.col(key), F.concat(path, F.lit("@"), k)).otherwise(F.col(path))
    return full.withColumn(path, name).select(*docs.columns)


def tree(df: DataFrame, path: str) -> DataFrame:
    """(path, parent, label, depth, is_file): all folders and .html files of a list of relative paths, each once.

    Names that begin with '.' or '_' are left out with all below them. Folders of other files only are listed too.
    """
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    p = df.where(F.col(path).isNotNull() & (F.col(path) != "")).select(parts.alias("parts")).where(~F.exists("parts", lambda x: x.startswith(".") | x.startswith("_")))
    n = F.explode(F.sequence(F.lit(1), F.size("parts")))
    nodes = p.withColumn("depth", n).withColumn("is_file", F.col("depth") == F.size("parts"))
    nodes = nodes.select(
        F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("path"),
        F.when(F.col("depth") > 1, F.array_join(F.slice("parts", F.lit(1), F.col("depth") - 1), "/")).alias("parent"),
        F.element_at("parts", F.col("depth")).alias("label"),
        "depth",
        "is_file",
    )
    return nodes.where(~F.col("is_file") | F.col("path").endswith(".html")).distinct()


def search_tree(nodes: DataFrame, text: str) -> DataFrame:
    """The nodes to show for a search: those whose label or path holds the text in any case, their ancestors, and all below
    a hit."""
    hit = nodes.where(F.lower("label").contains(text.lower()) | F.lower("path").contains(text.lower())).select("path")
    parts = F.split("path", "/")
    up = hit.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path"))
    # As a path holds its ancestors' names, whatever lies below a hit is a hit by its own path.
    return nodes.join(up.distinct(), "path", "left_semi")
