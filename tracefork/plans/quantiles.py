"""Exact group quantiles (linear interpolation) that stay distributed when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefork.plans.skew import salted_join
from tracefork.session import durable

SAMPLE = 4096
PIVOTS = 63
MAX_RANKED = 1_000_000
GRAIN = 1 << 30


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, sample: int = SAMPLE, max_ranked: int = MAX_RANKED
) -> DataFrame:
    """``(keys, quantile)`` as ``numpy.quantile`` gives it; null values are ignored.

    Equal values are first counted together (map-side) and the counts written once. Groups of more than ``max_ranked``
    distinct values are narrowed before they are ranked. The final ranking is a sorted, spillable window; no step gathers
    a group in memory.
    """
    keys = list(keys)
    upto = W.partitionBy(*keys).orderBy("value")
    told = [salted_join(rows, bounds, keys, ["value"]) for rows, bounds in narrowed(df, keys, value, q, sample, max_ranked)]
    every = told[0]
    for more in told[1:]:
        every = every.unionByName(more)
    ranked = every.withColumn("cum", F.sum("n").over(upto) + F.col("skipped"))

    def order_stat(r: str) -> Column:
        return F.min(F.when(F.col("cum") > F.col(r), F.col("value")))

    return (
        ranked.groupBy(*keys)
        .agg(order_stat("r0").alias("v0"), order_stat("r1").alias("v1"), F.first("frac").alias("frac"))
        .select(*keys, (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias("quantile"))
    )


def narrowed(
    df: DataFrame, keys: list[str], value: str, q: float, sample: int = SAMPLE, max_ranked: int = MAX_RANKED
) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of (keys, value, n) and (keys, r0, r1, frac, skipped, left): together, each group stands in one pair's bounds.

    ``r0`` and ``r1`` are the 0-based ranks of the two wanted order statistics, ``skipped`` the rows below the values that
    are left. Rows of groups that a pair's bounds don't name are not of that pair. A group has at most ``max_ranked``
    distinct values left (two where that is less).
    """
    counts = durable(
        df.select(*keys, F.col(value).cast("double").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("n"))
    )
    at = (F.col("total") - 1) * F.lit(float(q))
    bounds = durable(
        counts.groupBy(*keys)
        .agg(F.sum("n").alias("total"), F.count("*").alias("left"))
        .select(
            *keys,
            F.floor(at).cast("bigint").alias("r0"),
            F.least(F.floor(at) + 1, F.col("total") - 1).cast("bigint").alias("r1"),
            (at - F.floor(at)).alias("frac"),
            F.lit(0).cast("bigint").alias("skipped"),
            "left",
        )
    )
    rows, pairs, most = counts, [], max(max_ranked, 2)
    while not (wide := bounds.where(F.col("left") > most)).isEmpty():
        pairs.append((rows, bounds.where(F.col("left") <= most)))
        rows, bounds = _narrow(rows, wide, keys, sample, len(pairs))
    return [*pairs, (rows, bounds)]


def _narrow(rows: DataFrame, wide: DataFrame, keys: list[str], sample: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Of the groups in ``wide``, the values between the two pivots around the wanted ranks; both results are written once.

    Pivots stand at even distances in a hash sample of a group's distinct values, about ``sample`` of them, so a turn
    leaves about one value in ``PIVOTS`` however the values lie. Where the two ranks fall on both sides of a pivot, they
    are the last value below it and the first one above, and nothing else is left.
    """
    chance = F.pmod(F.xxhash64(F.lit(turn), "value"), F.lit(GRAIN)) < F.lit(float(GRAIN) * sample) / F.col("left")
    drawn = salted_join(rows, wide.select(*keys, "left"), keys, ["value"]).where(chance)
    at = lambda i: F.floor(i * F.size("drawn") / F.lit(PIVOTS + 1)).cast("int")
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(PIVOTS)), lambda i: F.get("drawn", at(i))))
    pivots = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("drawn")).select(*keys, spaced.alias("pivots"))
    told = durable(wide.join(pivots, keys, "left"))
    bin_ = F.coalesce(F.size(F.filter("pivots", lambda p: p <= F.col("value"))), F.lit(0))
    hist = (
        salted_join(rows, told.select(*keys, "pivots"), keys, ["value"])
        .select(*keys, bin_.alias("bin"), "value", "n")
        .groupBy(*keys, "bin")
        .agg(
            F.sum("n").alias("rows"),
            F.count("*").alias("values"),
            F.min("value").alias("low"),
            F.max(F.struct("value", "n")).alias("high"),
        )
    )
    upto = W.partitionBy(*keys).orderBy("bin")
    cum = hist.withColumn("cum", F.sum("rows").over(upto)).join(told.select(*keys, "r0", "r1", "frac", "skipped"), keys)
    below = F.col("cum") - F.col("rows") + F.col("skipped")
    holds = [(F.col("cum") + F.col("skipped") > F.col(r)) & (below <= F.col(r)) for r in ("r0", "r1")]
    first, last = F.min(F.struct("bin", "low", "high", below.alias("below"), "rows", "values")), F.max(F.struct("bin", "low", "high"))
    ends = (
        cum.where(holds[0] | holds[1])
        .groupBy(*keys)
        .agg(first.alias("a"), last.alias("b"), *[F.first(c).alias(c) for c in ("r0", "r1", "frac")])
    )
    one = F.col("a.bin") == F.col("b.bin")
    next_bounds = durable(
        ends.select(
            *keys,
            "r0",
            "r1",
            "frac",
            F.when(one, F.col("a.below")).otherwise(F.col("a.below") + F.col("a.rows") - F.col("a.high.n")).alias("skipped"),
            F.when(one, F.col("a.values")).otherwise(F.lit(2)).cast("bigint").alias("left"),
            F.when(one, F.col("a.low")).otherwise(F.col("a.high.value")).alias("low"),
            F.when(one, F.col("b.high.value")).otherwise(F.col("b.low")).alias("high"),
        )
    )
    inside = salted_join(rows, next_bounds.select(*keys, "low", "high"), keys, ["value"])
    left = durable(inside.where(F.col("value").between(F.col("low"), F.col("high"))).select(*keys, "value", "n"))
    return left, next_bounds.drop("low", "high")
