"""Comparing all rows within buckets, as Arrow batches sorted by bucket.

``keyed`` brings the rows of a bucket together. A bucket above ``cap`` rows is cut into blocks by row hash,
and every pair of its blocks becomes a bucket of its own, so a hot bucket is compared whole by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.session import sent, stage

#: Rows of one bucket, or of one block of a hot bucket, that a task compares at once.
CAP = 4096
ROWS_A_TASK = 25_000


def keyed(rows: DataFrame, key: str, rid: str, cap: int = CAP, copies: int | None = None) -> DataFrame:
    """``rows`` with columns p, q, blk added, partitioned and sorted by (key, p, q).

    Of a normal bucket p = q = blk = 0. Of a hot one each row is in block blk and stands in every bucket (p, q)
    that pairs its block with another or with itself.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select(key, F.ceil(F.col("n") / cap).cast("int").alias("blocks"))
    hot = stage(hot, "hot")
    if not hot.isEmpty():
        rows = rows.join(sent(hot), key, "left")
        blk = F.pmod(F.xxhash64(rid), F.coalesce("blocks", F.lit(1))).cast("int")
        rows = rows.withColumn("blk", blk).withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = rows.withColumn("p", F.least("blk", "o")).withColumn("q", F.greatest("blk", "o")).drop("o", "blocks")
    else:
        rows = rows.withColumns({"p": F.lit(0), "q": F.lit(0), "blk": F.lit(0)})
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if copies:
        n = max(n, -(-copies // ROWS_A_TASK))
    return rows.repartition(n, key, "p", "q").sortWithinPartitions(key, "p", "q")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole buckets: consecutive rows are held until the bucket (key, p, q) of the last row changes, so every
    table ends at a bucket's end."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k, p, q = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (key, "p", "q"))
        same = (k == k[-1]) & (p == p[-1]) & (q == q[-1])
        cut = 0 if same.all() else int(len(k) - np.argmin(same[::-1]))
        if cut or (last is not None and last != (k[0], p[0], q[0])):
            if held and last != (k[0], p[0], q[0]):
                yield pa.Table.from_batches(held)
                held = []
            if cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
                held = []
        held.append(b.slice(cut))
        last = (k[-1], p[-1], q[-1])
    if held:
        yield pa.Table.from_batches(held)


def spans(t: pa.Table, key: str) -> np.ndarray:
    """Start positions of the buckets of a table, with its length at the end."""
    k, p, q = (t.column(c).to_numpy() for c in (key, "p", "q"))
    new = (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(k)]])


def near_pairs(starts: np.ndarray, p: np.ndarray, q: np.ndarray, blk: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs within buckets that pass ``test``; pairs of one block count only in its own bucket.
    Works by distance in the sorted order: all rows with their next neighbour, then the one after, and so on."""
    n = starts[-1]
    size = np.diff(starts)
    left = np.repeat(starts[1:], size) - np.arange(n) - 1
    out_i, out_j = [], []
    i = np.arange(n)
    step = 1
    while True:
        i = i[left[i] >= step]
        if not len(i):
            break
        j = i + step
        ok = (p[i] == q[i]) | (blk[i] != blk[j])
        a, b = (i, j) if ok.all() else (i[ok], j[ok])
        if len(a):
            hit = test(a, b)
            out_i.append(a[hit])
            out_j.append(b[hit])
        step += 1
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)
