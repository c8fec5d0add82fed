"""Reproducible uniform draws from a key string (md5), identical on any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw_between(low: Column, high: Column, *key: Column) -> Column:
    """Uniform integer in ``[low, high]``."""
    return low.cast("bigint") + F.pmod(key_hash(*key), high.cast("bigint") - low.cast("bigint") + 1)


def draw_direction(*key: Column) -> Column:
    """'path' or 'cov' with equal odds."""
    return F.when(key_hash(*key) % 2 == 0, F.lit("path")).otherwise(F.lit("cov"))
