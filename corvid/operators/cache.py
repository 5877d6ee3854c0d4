"""Bounded recent-item lists with expiry, as batch operators; ``corvid.streaming.state`` holds their streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.ranges import ranged

MAX_MESSAGES, MAX_CHATS, TTL_SECONDS = 20, 5, 3600


def bounded(df: DataFrame, key: str, order: list[str], n: int = MAX_MESSAGES, keep: str = "last") -> DataFrame:
    """The items a list of at most ``n`` keeps for each key, with ``pos`` from 0: the newest ones, or with keep='first' the
    oldest, as an append that trims the tail does. Null keys have no list."""
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    o = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    kept = df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*o))).where(F.col("_r") <= n)
    if keep == "first":
        return kept.withColumn("pos", F.col("_r") - 1).drop("_r")
    size = F.max("_r").over(Window.partitionBy(key))
    return kept.withColumn("pos", size - F.col("_r")).drop("_r")


def read(cached: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` items of each list, oldest first."""
    return cached.where(F.col("pos") < limit)


def read_entries(ids: DataFrame, entries: DataFrame, key: str, entry: str, limit: int) -> DataFrame:
    """Lists of ids cut to ``limit``, then joined to the cached entries: missing ones are dropped, so fewer may come back."""
    return ids.where(F.col("pos") < limit).join(entries, entry)


def segments(df: DataFrame, key: str, ts: str, order: list[str], ttl: int = TTL_SECONDS) -> DataFrame:
    """``df`` with ``segment``: the list's number, a new one where more than ``ttl`` seconds passed since the key's last item.

    Keys may be of any size: pauses are counted range by range, and a range's first item is compared with the last of the
    key's range before. Rows with a null key or time are dropped."""
    by = [F.col(c) for c in (ts, *order)]
    r = ranged(df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()), [key], by)
    pause = lambda a, b: F.coalesce(F.timestamp_diff("MICROSECOND", a, b) > ttl * 1_000_000, F.lit(False)).cast("bigint")
    w = Window.partitionBy(key, "_range").orderBy(*by)
    r = r.withColumn("_new", pause(F.lag(ts).over(w), F.col(ts)))
    k = Window.partitionBy(key).orderBy("_range")
    ends = r.groupBy(key, "_range").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.sum("_new").alias("_n"))
    ends = ends.withColumn("_edge", pause(F.lag("_hi").over(k), F.col("_lo")))
    before = F.coalesce(F.sum("_n").over(k.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("_edge").over(k.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.select(key, "_range", before.alias("_before"))
    own = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("_own", own).join(ends, [key, "_range"]).select(*df.columns, (F.col("_own") + F.col("_before")).alias("segment"))


def live(entries: DataFrame, written: str, as_of, ttl: int = TTL_SECONDS) -> DataFrame:
    """Keyed entries that have not expired at ``as_of`` (a timestamp column or literal)."""
    return entries.where(F.timestamp_diff("MICROSECOND", F.col(written), F.lit(as_of).cast("timestamp_ntz")) <= ttl * 1_000_000)


def cache_aside(cached: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """For each key the cached items if there are any, else the stored ones; ``origin`` says which."""
    have = cached.select(key).distinct()
    return cached.withColumn("origin", F.lit("cache")).unionByName(stored.join(have, key, "left_anti").withColumn("origin", F.lit("store")), allowMissingColumns=True)


def filled(cached: DataFrame, stored: DataFrame, key: str, order: list[str], n: int = MAX_MESSAGES) -> DataFrame:
    """The cache after such reads: its own lists, and for keys it lacked those of the store, bounded to the newest ``n`` by
    ``order``; ``pos`` from 0, oldest first."""
    both = cache_aside(cached.drop("pos") if "pos" in cached.columns else cached, stored, key)
    return bounded(both, key, order, n)


def invalidate(cached: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return cached.join(keys.select(key).distinct(), key, "left_anti")


def merge_lists(cached: DataFrame, pairs: DataFrame, key: str, order: list[str], n: int = MAX_CHATS) -> DataFrame:
    """Lists of merged keys (from_id, to_id) joined into the target's and bounded again."""
    p = pairs.groupBy(F.col("from_id").alias(key)).agg(F.min("to_id").alias("to_id"))
    moved = cached.drop("pos").join(p, key, "left").withColumn(key, F.coalesce("to_id", F.col(key))).drop("to_id")
    return bounded(moved.distinct(), key, order, n)


def rehydrate(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows from JSON lines; undecodable ones fall out."""
    return lines.withColumn("_row", F.from_json(column, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("_row IS NOT NULL AND _row._bad IS NULL").select("_row.*").drop("_bad")
