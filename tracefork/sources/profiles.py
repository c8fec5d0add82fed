"""Failure profiles and routing records as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefork.operators.reports import PANEL_SCHEMA
from tracefork.schemas import PROFILE


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profile CSV by header name; an empty file or a value that is no number is an error."""
    df = spark.read.schema(PROFILE).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Routing records ``(pid, feats, rescuers)`` from JSON-array files."""
    return spark.read.schema(PANEL_SCHEMA).option("multiLine", True).json(path)


def save_records(records: DataFrame, path: str) -> None:
    records.select("pid", "feats", "rescuers").write.json(path)
