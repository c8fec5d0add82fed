"""Registered queries: a name, a Spark plan over the given tables, and (where SQL can say it) an oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r6(name: str, expr: Column | None = None) -> Column:
    """A floating column rounded for comparison."""
    return F.round(F.col(name) if expr is None else expr, 6).alias(name)


def s6(name: str, expr: str | None = None) -> str:
    """The SQL twin of ``r6``; adding 0 turns a negative zero into zero."""
    return f"round({expr or name}, 6) + 0 AS {name}"


def pick(df: DataFrame, plain: Sequence[str], rounded: Sequence[str] = ()) -> DataFrame:
    return df.select(*plain, *[r6(c) for c in rounded])


def pick_sql(plain: Sequence[str], rounded: Sequence[str] = ()) -> str:
    return ", ".join([*plain, *[s6(c) for c in rounded]])
