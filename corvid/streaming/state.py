"""Structured Streaming forms: last message times, bounded lists with expiry, and ingest of new documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvid.operators.cache import MAX_MESSAGES, TTL_SECONDS
from corvid.session import shared_dir


def read_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(folder)


def last_seen(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """(key, last): the latest event time of each key, for output mode update or complete. ``ts`` may be without zone and
    is then read as the session's time; null keys and times are dropped, late events cannot lower a maximum."""
    s = stream.where(F.col(key).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).where("_ts IS NOT NULL").withWatermark("_ts", delay)
    return s.groupBy(key).agg(F.max("_ts").alias("last"))


def bounded_lists(stream: DataFrame, key: str, item: str, ts: str, n: int = MAX_MESSAGES, ttl: int = TTL_SECONDS, keep: str = "last", delay: str = "1 hour") -> DataFrame:
    """(key, items, size): each key's list after every batch: the ``n`` newest (or oldest) items since the last pause of more
    than ``ttl`` seconds. State per key is the list itself, so it is bounded; a key whose last item is ``ttl`` seconds
    behind the watermark is forgotten."""
    kind = dict(stream.dtypes)[key]

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = list(zip(*state.get)) if state.exists else []
        rows = old + [(int(t), str(i)) for f in frames for t, i in zip(f["_us"], f["_item"])]
        held: list[tuple[int, str]] = []
        for t, i in sorted(rows):
            if held and t - held[-1][0] > ttl * 1_000_000:
                held = []
            held.append((t, i))
            if len(held) > n and keep == "last":
                held.pop(0)
        full = held[:n] if keep == "first" else held
        state.update(([t for t, _ in full], [i for _, i in full]))
        state.setTimeoutTimestamp(max(full[-1][0] // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "items": [",".join(i for _, i in full)], "size": [len(full)]})

    s = stream.where(F.col(key).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).where("_ts IS NOT NULL").withWatermark("_ts", delay)
    s = s.select(key, "_ts", F.unix_micros("_ts").alias("_us"), F.col(item).cast("string").alias("_item"))
    return s.groupBy(key).applyInPandasWithState(
        update, f"`{key}` {kind}, items string, size int", "t array<bigint>, i array<string>", "update", GroupStateTimeout.EventTimeTimeout
    )


def run_once(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Process what is there and return the result: in mode complete the last batch's, else the rows of all batches. Checkpoint
    and batches lie in the shared folder, a batch that is run again replaces its own."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/corvid-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{at}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def ingest_stream(stream: DataFrame, pipeline, at: str, checkpoint: str):
    """New documents through a batch pipeline, micro-batch by micro-batch, each into its own partition ``batch``: one that is run
    again after a failure replaces what it wrote. Returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{at}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
