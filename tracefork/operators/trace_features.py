"""Trace and problem features over cached rollouts (one row per rollout, aligned arrays). Narrow until
the final per-problem average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefork.functions import arrays as A

# The profile features, in their published order.
PROFILE_FEATURES = ["logit_var", "J_approx", "kl_div", "Delta_path", "G_cov", "entropy"]
JUNCTION_HALF_WIDTH = 8


def kept_length(kl: Column) -> Column:
    """Tokens kept after the trailing trim: through the last non-zero divergence, or all."""
    return A.let(
        kl,
        lambda v: A.let(
            F.array_position(F.transform(F.reverse(v), lambda x: x != 0.0), True),
            lambda tail: F.when(tail > 0, F.size(v) - tail + 1).otherwise(F.size(v)),
        ),
    ).cast("int")


def trim(traces: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Cut every feature array after its last position with non-zero ``kl_div``; drop empty traces."""
    names = names or PROFILE_FEATURES
    keep = [c for c in traces.columns if c not in names]
    cut = traces.withColumn("_hi", kept_length(F.col("kl_div")))
    return cut.select(*keep, *[F.slice(F.col(n), F.lit(1), F.col("_hi")).alias(n) for n in names]).where(
        F.size("J_approx") > 0
    )


def junction(trimmed: DataFrame, half_width: int = JUNCTION_HALF_WIDTH) -> DataFrame:
    """Add ``junction`` (first argmax of J) and its window bounds ``lo`` (incl.) and ``up`` (excl.)."""
    size = F.size("J_approx")
    return trimmed.withColumn("junction", A.argmax(F.col("J_approx"))).withColumns(
        {
            "lo": F.greatest(F.lit(0), F.col("junction") - half_width).cast("bigint"),
            "up": F.least(size, F.col("junction") + half_width + 1).cast("bigint"),
        }
    )


def _window_mean(values: Column) -> Column:
    return A.amean(F.slice(values, (F.col("lo") + 1).cast("int"), (F.col("up") - F.col("lo")).cast("int")))


def rollout_profile(traces: DataFrame, half_width: int = JUNCTION_HALF_WIDTH) -> DataFrame:
    """Trace mean and junction-window mean of each profile feature, per rollout."""
    j = junction(trim(traces), half_width)
    means = []
    for f in PROFILE_FEATURES:
        means += [A.amean(F.col(f)).alias(f"{f}_trace"), _window_mean(F.col(f)).alias(f"{f}_junc")]
    return j.select("pid", "rollout_idx", "junction", "lo", "up", *means)


def problem_profile(traces: DataFrame, half_width: int = JUNCTION_HALF_WIDTH) -> DataFrame:
    """Mean of rollout profiles per problem."""
    cols = [f"{f}_{s}" for f in PROFILE_FEATURES for s in ("trace", "junc")]
    return rollout_profile(traces, half_width).groupBy("pid").agg(*[F.avg(c).alias(c) for c in cols])


def rollout_routing_features(traces: DataFrame, half_width: int = JUNCTION_HALF_WIDTH) -> DataFrame:
    """spread, concentration and logit_dispersion per rollout."""
    j = junction(trim(traces), half_width)
    tiny = F.lit(1e-8)
    spread = A.amean(F.transform("J_approx", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    peak = F.array_max("J_approx") / F.greatest(A.amean(F.col("J_approx")), tiny)
    return j.select(
        "pid",
        "rollout_idx",
        spread.alias("spread"),
        F.log10(F.greatest(peak, tiny)).alias("concentration"),
        F.log10(F.greatest(_window_mean(F.col("logit_var")), tiny)).alias("logit_dispersion"),
    )


def routing_features(traces: DataFrame, half_width: int = JUNCTION_HALF_WIDTH) -> DataFrame:
    """Rollout-averaged routing features per problem."""
    return (
        rollout_routing_features(traces, half_width)
        .groupBy("pid")
        .agg(*[F.avg(c).alias(c) for c in ("spread", "concentration", "logit_dispersion")])
    )
