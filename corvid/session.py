"""Sessions, shipping of the package to executors, and written intermediate tables.

``stage`` is the one way this library cuts lineage: a table written to the folder that every
executor shares (``spark.checkpoint.dir``). A lost executor therefore costs a re-read, never a
recomputation from half-gone state.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; texts may be 100,000 characters, so far below Spark's 10,000.
ARROW_ROWS = 1000

_STAGED: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local runs; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Settings that Python stages need. Ships this package once, so that executors without it can run them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if sc.master.startswith("local[") or getattr(sc, "_corvid_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(), "corvid_pkg.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("corvid", os.path.relpath(full, root)))
    sc.addPyFile(at)
    sc._corvid_shipped = True


#: A table is broadcast only if its rows, as counted by ``bytes_of``, take at most this many bytes.
BROADCAST_BYTES = 32 << 20


def bytes_of(df: DataFrame) -> int:
    """A measure of the bytes all rows of ``df`` take: lengths of strings and arrays, eight bytes for anything else."""

    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if kind == "array<string>":
            return F.coalesce(F.aggregate(c, F.lit(16), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(16))
        if kind.startswith("array"):
            return F.coalesce(F.greatest(F.size(c), F.lit(0)) * 8, F.lit(0)) + 16
        return F.lit(8)

    row = sum((one(n, k) for n, k in df.dtypes), F.lit(16))
    return df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0))).first()[0]


def sent(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked to be broadcast if its measured bytes allow it, else as it is, so that the join shuffles. Measured on
    all rows: stage what is dear to compute."""
    return F.broadcast(df) if bytes_of(df) <= limit else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Read from the session; set here only where nobody has set it, which only a local session
    may do: on a cluster a folder of one machine would lose tables without a word, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="corvid-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the table is removed when a ``staging`` around it or the process ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/corvid-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    _STAGED.append((spark, at))
    return spark.read.schema(df.schema).parquet(at)


def release(since: int = 0) -> None:
    """Remove the staged tables written after the first ``since`` of them: results that read them must be written by then."""
    while len(_STAGED) > since:
        spark, at = _STAGED.pop()
        try:
            sc = spark.sparkContext
            if sc._jsc is None:
                continue
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:
            pass


@contextlib.contextmanager
def staging() -> Iterator[None]:
    """Within it staged tables live; at its end they are removed. For long sessions: write a query's result inside."""
    before = len(_STAGED)
    try:
        yield
    finally:
        release(before)


atexit.register(release)
