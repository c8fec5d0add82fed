"""Dense row numbers within keys, without sorting a hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefork.session import durable, small_side

HOT_ROWS = 500_000


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``name`` = 0-based place of each row within its key by ``order``.

    Keys of at most ``hot_rows`` rows are numbered by a plain window. Keys above it, found by a count
    over the key columns alone, go through ``number_hot``; there are at most rows / ``hot_rows`` of them.
    ``bucket`` must not decrease along ``order`` (a coarser form of its leading columns).
    """
    keys = list(keys)
    hot = durable(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*keys))
    place = (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint")
    if hot.isEmpty():
        return df.withColumn(name, place)
    hot = small_side(hot)
    plain = df.join(hot, keys, "left_anti").withColumn(name, place)
    return plain.unionByName(number_hot(df.join(hot, keys, "left_semi"), keys, order, bucket, name))


def number_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """The same numbers, sorting per (key, bucket) only, so that one key is spread over its buckets.

    The places before a bucket are a running sum over the bucket counts. The numbers are a function of
    the data alone, so recomputed tasks give the same ones.
    """
    parts = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket).repartition(*parts)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*parts)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    place = F.row_number().over(W.partitionBy(*parts).orderBy(*order)) - 1
    return (
        rows.withColumn("_place", place)
        .join(offsets, parts)
        .withColumn(name, (F.col("_place") + F.col("_before")).cast("bigint"))
        .drop("_bucket", "_place", "_before")
    )
