"""Joins that stay spread out when one key holds a large share of the big side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: A key above so many rows is cut into pieces of about that size.
HOT_ROWS = 1_000_000
#: Keys that a task's sketch follows, and the most that are ever called hot.
TRACKED, MOST_HOT = 100_000, 10_000


def salted_join(
    big: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join ``big`` to a one-row-per-key table over (keys, salt).

    The salt is a hash of ``spread`` columns of the big side, so recomputed tasks agree. The small rows
    are repeated once per salt. An aggregate or window on ``keys`` downstream then combines partially
    before its own exchange, instead of inheriting a partitioning with one hot partition.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return (
        big.withColumn("_salt", salt)
        .join(per_key.withColumn("_salt", F.explode(every)), [*keys, "_salt"], how)
        .drop("_salt")
    )


def hot_keys(big: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(``_h``, ``_salts``): the hash of each key above ``hot_rows`` rows and the pieces that its rows make; None without any.

    Found by one heavy-hitter sketch over the key columns: a buffer of fixed size from each task, no shuffle of keys. The
    sketch knows every key that holds more than about 4 / ``TRACKED`` of all rows; a smaller one needs no salt.
    At most ``MOST_HOT`` rows come back, so the table may be broadcast.
    """
    sketch = F.expr(f"approx_top_k(_h, {MOST_HOT}, {TRACKED})")
    top = big.select(F.xxhash64(*keys).alias("_h")).agg(sketch.alias("top")).head()[0] or []
    hot = [(r["item"], math.ceil(r["count"] / hot_rows)) for r in top if r["item"] is not None and r["count"] > hot_rows]
    return big.sparkSession.createDataFrame(hot, "_h bigint, _salts int") if hot else None


def with_salts(df: DataFrame, keys: Sequence[str], hot: DataFrame, salt: Column) -> DataFrame:
    """Add ``_salt`` by ``salt``, which may name ``_salts``, the pieces of the row's key (1 unless hot)."""
    told = df.withColumn("_h", F.xxhash64(*keys)).join(F.broadcast(hot), "_h", "left")
    return told.withColumn("_salts", F.coalesce("_salts", F.lit(1))).withColumn("_salt", salt).drop("_h", "_salts")


def dealt(big: DataFrame, keys: Sequence[str], spread: Sequence[str], hot: DataFrame) -> DataFrame:
    """``big`` with ``_salt``: rows of hot keys over their pieces by a hash of ``spread``, all others 0."""
    return with_salts(big, keys, hot, F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"))


def hot_join(
    big: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` to a one-row-per-key table, salting only the keys found hot, by as many salts as their rows ask for.

    For tables whose rows per key are not bounded and whose small rows are wide: the row of a key that isn't hot moves
    once. Reads the key columns of ``big`` one time more, or those of ``counted``, a table whose rows ``big`` was made of.
    """
    hot = hot_keys(big if counted is None else counted, keys, hot_rows)
    if hot is None:
        return big.join(per_key, list(keys), how)
    copies = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    return dealt(big, keys, spread, hot).join(with_salts(per_key, keys, hot, copies), [*keys, "_salt"], how).drop("_salt")
