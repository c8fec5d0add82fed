"""Reading the given tables and keeping intermediate results."""

from __future__ import annotations

import gc
import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefork.session import durable

#: Spark's cleaner works in the background; it gets so long after a collection.
PAUSE_S = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(build: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """A DataFrame, or what ``build`` returns, written once in the shared folder; the shuffle files behind it may go.

    Spark drops shuffle files when the driver collects the plan that made them, so nothing may hold that plan (hence
    ``build``) and the collection is asked for.
    """
    if callable(build):
        kept = durable(build())
    else:
        kept = durable(build)
        del build
    for _ in range(2):  # what the first collection lets go of, the second one finds
        gc.collect()
        kept.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(PAUSE_S)
    return kept


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over the whole table; nulls count nothing."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).head()[0] or 0


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``total``."""
    return max(least, math.ceil(total / each))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
