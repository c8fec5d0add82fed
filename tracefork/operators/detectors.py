"""Junction detectors over step tables. Each takes and returns DataFrames keyed by trace and step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefork.functions import arrays as A
from tracefork.functions.draws import draw_between
from tracefork.plans.quantiles import exact_quantile
from tracefork.plans.skew import salted_join
from tracefork.schemas import TRACE

# Fixed values of the detectors.
SKIP_STEPS = 5
ENTROPY_THRESHOLD = 2.0
ENTROPY_EPS = 1e-12
MIN_STEP = 20
SCORE_THRESHOLD = 1.0
TOP_SHARE = 0.9
COVERAGE_TOP_K = 5
WINDOW_SHARE = 0.10
SEED = 42


class Detector(Protocol):
    """The plug-in surface: a batch plan over a step table.

    A stateful detector adds ``stream(steps)`` over the same columns, as ``streaming.PageHinkley`` does;
    grouping by rollout is its reset.
    """

    def batch(self, steps: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ThresholdDetector:
    """A detector stated as a column: first step of each trace where ``condition`` holds."""

    condition: Callable[[], Column]
    min_step: int = 0

    def batch(self, steps: DataFrame) -> DataFrame:
        return first_step(steps, self.condition() & (F.col("t") >= self.min_step))


def first_step(steps: DataFrame, condition: Column) -> DataFrame:
    return steps.where(condition).groupBy(*TRACE).agg(F.min("t").alias("step"))


def outcome_contrast(failed: DataFrame, succeeded: DataFrame, skip_thinking: bool = True) -> DataFrame:
    """First step where paired failed and successful token ids differ.

    Both are ``(pair, t, token_id)``. Joined on pair and step, so long pairs are spread by step.
    """
    first = SKIP_STEPS if skip_thinking else 0
    a = failed.select("pair", "t", F.col("token_id").alias("fail_id")).where(F.col("t") >= first)
    b = succeeded.select("pair", "t", F.col("token_id").alias("succ_id")).where(F.col("t") >= first)
    return (
        a.join(b, ["pair", "t"])
        .where(F.col("fail_id") != F.col("succ_id"))
        .groupBy("pair")
        .agg(F.min("t").alias("step"))
    )


def ancestor_divergence(pairs: DataFrame) -> DataFrame:
    """Flag positions where the greedy choices differ."""
    return pairs.withColumns(
        {"top_s": A.argmax(F.col("z_s")), "top_a": A.argmax(F.col("z_a"))}
    ).withColumn("fires", F.col("top_s") != F.col("top_a"))


def uncertainty_fork(pairs: DataFrame, threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    return pairs.withColumn("uncertainty", A.entropy(A.softmax(F.col("z_s")), ENTROPY_EPS)).withColumn(
        "fires", F.col("uncertainty") > threshold
    )


def demotion_scores(pairs: DataFrame) -> DataFrame:
    """``d_t = log p_S(x_t) - log p_A(x_t)`` at temperature 1; null where a model's logits are missing."""
    def lp(z: str) -> Column:
        return A.at(A.log_softmax(F.col(z)), F.col("x_t"))

    return pairs.withColumn("d_t", lp("z_s") - lp("z_a"))


def demotion_fixed(scored: DataFrame, threshold: float = SCORE_THRESHOLD, min_step: int = MIN_STEP) -> DataFrame:
    return scored.where((F.col("t") >= min_step) & (F.col("d_t") > threshold))


def top_share_flags(steps: DataFrame, value: str, share: float = TOP_SHARE, min_step: int = MIN_STEP) -> DataFrame:
    """Steps at or above the trace's ``share`` quantile of ``value``, from ``min_step`` on."""
    cut = exact_quantile(steps, TRACE, value, share).withColumnRenamed("quantile", "cut")
    return salted_join(steps, cut, TRACE, ["t"]).where((F.col(value) >= F.col("cut")) & (F.col("t") >= min_step))


def select_top(steps: DataFrame, value: str, k: int = 1) -> DataFrame:
    """Top ``k`` steps per trace, missing scores last, ties to the earlier step.

    The rank limit runs before the shuffle as well, so a long trace sends at most ``k`` rows per task.
    """
    w = W.partitionBy(*TRACE).orderBy(F.col(value).desc_nulls_last(), "t")
    ranked = steps.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return ranked.withColumn("place", F.col("place").cast("bigint"))


def coverage_gap(pairs: DataFrame, k: int = COVERAGE_TOP_K) -> DataFrame:
    """``c_t`` = positive part of p_A - p_S summed over the ancestor's top ``k`` tokens."""
    best = A.top_entries(A.softmax(F.col("z_a")), k, A.softmax(F.col("z_s")))
    gap = F.aggregate(best, F.lit(0.0), lambda acc, e: acc + F.greatest(e["score"] - e["p0"], F.lit(0.0)))
    return pairs.withColumn("c_t", gap)


def trace_zscore(steps: DataFrame, value: str, name: str) -> DataFrame:
    """Population z-score within each trace (0 for a flat one)."""
    stats = steps.groupBy(*TRACE).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") == 0.0, 0.0).otherwise(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    return salted_join(steps, stats, TRACE, ["t"]).withColumn(name, z).drop("_m", "_s")


def coverage_fixed(steps: DataFrame, threshold: float = SCORE_THRESHOLD, min_step: int = MIN_STEP) -> DataFrame:
    return trace_zscore(steps, "c_t", "coverage_z").where(
        (F.col("coverage_z") > threshold) & (F.col("t") >= min_step)
    )


def trace_lengths(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*TRACE).agg(F.count("*").alias("length"))


def matched_position(refs: DataFrame, share: float = WINDOW_SHARE, seed: int = SEED) -> DataFrame:
    """A reproducible step near ``ref_step``: within half a window of a tenth of the trace."""
    half = F.floor(F.greatest(F.lit(2), F.floor(F.lit(share) * F.col("length"))) / 2).cast("bigint")
    low = F.greatest(F.lit(0), F.col("ref_step") - half)
    high = F.least(F.col("length") - 1, F.col("ref_step") + half)
    key = (F.lit(seed), F.col("pid"), F.col("rollout_idx"), F.col("ref_step"))
    return refs.withColumns({"low": low, "high": high}).withColumn(
        "step", draw_between(F.col("low"), F.col("high"), *key)
    )


def random_position(lengths: DataFrame, seed: int = SEED) -> DataFrame:
    key = (F.lit(seed), F.col("pid"), F.col("rollout_idx"))
    draw = draw_between(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), *key)
    return lengths.withColumn("step", draw)
