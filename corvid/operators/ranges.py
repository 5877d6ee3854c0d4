"""Row numbers and running sums within keys of any size: no task sorts or holds a whole key.

Rows are range-partitioned by key and order, numbered within each range, and the few ranges of a key are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.session import stage


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``_range``: the number of the row's range in the order of (keys, order). Written once, so it stays as it is."""
    return stage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def earlier(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, _range, _before): the sum of an aggregate over the key's earlier ranges; one row a key and range."""
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(*keys, "_range").agg(value.alias("_n")).select(*keys, "_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place (from 0) within its key, by ``order``, which must leave no ties that matter. Rows
    with a null key form a key of their own and are dropped; an empty table stays empty."""
    r = ranged(df, keys, order)
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    own = r.withColumn("_own", F.row_number().over(w) - 1)
    return own.join(earlier(r, keys, F.count(F.lit(1))), [*keys, "_range"]).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))
