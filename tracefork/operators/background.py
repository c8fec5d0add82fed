"""Background statistics of failed rollouts and the offline firing rules they feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefork.functions import arrays as A
from tracefork.operators.selection import background_members
from tracefork.plans.skew import salted_join
from tracefork.schemas import TRACE

# Fixed values of the estimation.
SIGMA_PAD = 1e-6
LOG_V_FLOOR = 1e-8
Q_J = 0.99
Q_V = 0.75
WARMUP = 20
# The background of a case that has none.
DEFAULT_BACKGROUND = {
    "mu_path": 0.0,
    "sig_path": 1.0,
    "mu_cov": 0.0,
    "sig_cov": 1.0,
    "mu_logV": 0.0,
    "sig_logV": 1.0,
    "lambda_J": 0.0,
    "lambda_V": 0.0,
}


def scan_statistic(traces: DataFrame, w: int = 1, value: str = "J_approx") -> DataFrame:
    """Add ``S``: trailing sums of ``value`` over at most ``w`` positions."""
    return traces.withColumn("S", A.trailing_sums(F.col(value), w))


def estimate_background(
    members: DataFrame,
    keys: Sequence[str] = ("pid", "k"),
    w: int = 1,
    q_j: float = Q_J,
    q_v: float = Q_V,
    v_col: str = "V",
) -> DataFrame:
    """Pooled moments and quantile thresholds per key.

    ``members`` holds one row per (key, rollout) with the arrays ``Delta_path, G_cov, V, J_approx``.
    Sums are combined map-side. The exact quantiles keep a value histogram per key, which is bounded:
    a (pid, k) pools ``k`` rollouts of at most the context length each.
    """
    log_v = F.transform(F.col(v_col), lambda v: F.log(F.greatest(v.cast("double"), F.lit(LOG_V_FLOOR))))
    rows = (
        scan_statistic(members, w)
        .withColumn("log_v", log_v)
        .select(
            *keys,
            "rollout_idx",
            F.explode(F.arrays_zip("Delta_path", "G_cov", "log_v", "S")).alias("e"),
        )
        .select(
            *keys,
            "rollout_idx",
            *[F.col(f"e.{c}").cast("double").alias(c) for c in ("Delta_path", "G_cov", "log_v", "S")],
        )
    )
    pooled = rows.groupBy(*keys).agg(
        F.avg("Delta_path").alias("mu_path"),
        (F.stddev_pop("Delta_path") + SIGMA_PAD).alias("sig_path"),
        F.avg("G_cov").alias("mu_cov"),
        (F.stddev_pop("G_cov") + SIGMA_PAD).alias("sig_cov"),
        F.avg("log_v").alias("mu_logV"),
        (F.stddev_pop("log_v") + SIGMA_PAD).alias("sig_logV"),
        F.percentile("S", q_j).alias("lambda_J"),
        F.percentile("log_v", q_v).alias("_q_log_v"),
    )
    # The quantile of z-scores is the z-score of the quantile: the scaling is increasing and linear.
    return pooled.select(
        *keys,
        "mu_path",
        "sig_path",
        "mu_cov",
        "sig_cov",
        "mu_logV",
        "sig_logV",
        "lambda_J",
        ((F.col("_q_log_v") - F.col("mu_logV")) / F.col("sig_logV")).alias("lambda_V"),
        F.lit(w).cast("bigint").alias("w"),
        F.lit(q_j).alias("q_J"),
        F.lit(q_v).alias("q_V"),
    )


def backgrounds_for(
    failed: DataFrame,
    cache: DataFrame,
    k_values: Sequence[int],
    w: int = 1,
    q_j: float = Q_J,
    q_v: float = Q_V,
    prompts: DataFrame | None = None,
) -> DataFrame:
    """Background of every eligible (pid, k): the first ``k`` failures, all of them cached."""
    members = background_members(failed, cache, k_values, prompts)
    # A (pid, k) has at most k members, so its window is small.
    chosen = members.withColumn("n", F.count("*").over(W.partitionBy("pid", "k"))).where(F.col("n") >= F.col("k"))
    rows = chosen.select(*TRACE, "k").join(cache.select(*TRACE, "Delta_path", "G_cov", "V", "J_approx"), TRACE)
    return estimate_background(rows, ("pid", "k"), w, q_j, q_v)


def require_background(background: DataFrame) -> DataFrame:
    if background.isEmpty():
        raise ValueError("a background needs at least one failed, cached rollout")
    return background


def with_background(cases: DataFrame, background: DataFrame, keys: Sequence[str] = ("pid", "k")) -> DataFrame:
    """Left join the background; a case without one gets the neutral default."""
    names = list(DEFAULT_BACKGROUND)
    spread = [c for c in cases.columns if c not in keys] or list(keys)
    joined = salted_join(cases, background.select(*keys, *names), keys, spread, "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in DEFAULT_BACKGROUND.items()})


def direction(delta: Column, gap: Column) -> Column:
    """'path' or 'cov' by the larger clipped z-score, 'path' on ties; sigma is padded once more."""
    zp = F.greatest(F.lit(0.0), (delta - F.col("mu_path")) / (F.col("sig_path") + F.lit(SIGMA_PAD)))
    zc = F.greatest(F.lit(0.0), (gap - F.col("mu_cov")) / (F.col("sig_cov") + F.lit(SIGMA_PAD)))
    return F.when(zp >= zc, "path").otherwise("cov")


def wrong_direction(tau: Column) -> Column:
    return F.when(tau == "path", "cov").when(tau == "cov", "path")


def first_crossing(scan: Column, threshold: Column, first: int, last: Column | None = None) -> Column:
    """0-based index of the first value strictly above the threshold within ``[first, last]``; else null."""
    def find(s: Column, lam: Column, end: Column) -> Column:
        hits = F.transform(s, lambda x, i: (i >= first) & (i <= end) & (x > lam))
        return A.let(F.array_position(hits, True), lambda p: F.when(p > 0, p - 1))

    end = F.size(scan) - 1 if last is None else last
    return A.let(scan, lambda s: A.let(threshold, lambda lam: A.let(end, lambda e: find(s, lam, e)))).cast("bigint")


def firing_position(
    traces: DataFrame, background: DataFrame, w: int = 1, warmup: int = WARMUP, keys: Sequence[str] = ("pid",)
) -> DataFrame:
    """First ``t >= warmup`` with a full window and ``S_t > lambda_J``; only rollouts that fire."""
    bg = background.select(*keys, "lambda_J", "mu_path", "sig_path", "mu_cov", "sig_cov")
    scans = scan_statistic(traces.select(*TRACE, "Delta_path", "G_cov", "J_approx"), w)
    rows = salted_join(scans, bg, keys, ["rollout_idx"])
    fired = rows.withColumn(
        "t_hat", first_crossing(F.col("S"), F.col("lambda_J"), max(warmup, w - 1))
    ).where(F.col("t_hat").isNotNull())
    return fired.withColumn(
        "tau_hat", direction(A.at(F.col("Delta_path"), F.col("t_hat")), A.at(F.col("G_cov"), F.col("t_hat")))
    ).withColumn("S_hat", A.at(F.col("S"), F.col("t_hat")))


# Scores a fire record keeps, in token order.
_REPLAY = ["Z_path", "Z_cov", "J_t", "tau_t", "entropy_sensitive", "pS_on_set", "pA_on_set"]


def online_replay(
    scored: DataFrame, w: int = 1, warmup: int = WARMUP, max_new_tokens: int = 1024
) -> DataFrame:
    """Replay the online rule over scored tokens ``(…, t, J_t, lambda_J, …)``; one row per fired rollout.

    Token ``t`` is scored one step later, so the last token of a trace never is. Frozen after firing.
    """
    steps = F.sort_array(F.collect_list(F.struct("t", *_REPLAY)))
    traces = scored.groupBy(*TRACE).agg(steps.alias("steps"), F.first("lambda_J").alias("lambda_J"))
    traces = traces.withColumn("S", A.trailing_sums(F.transform("steps", lambda s: s["J_t"]), w))
    fired = traces.withColumn(
        "i",
        first_crossing(F.col("S"), F.col("lambda_J"), max(warmup, w - 1), F.size("S") - 2),
    ).where(F.col("i").isNotNull())
    at = A.at(F.col("steps"), F.col("i"))
    return fired.select(*TRACE, "lambda_J", at.alias("s"), A.at(F.col("S"), F.col("i")).alias("S_t")).select(
        *TRACE,
        F.col("s.t").cast("bigint").alias("t_hat"),
        F.col("s.tau_t").alias("tau_hat"),
        F.col("s.entropy_sensitive").alias("entropy_sensitive"),
        fire_score(max_new_tokens).alias("fire_score"),
    )


def fire_score(max_new_tokens: int) -> Column:
    """The record kept at a fire, from ``s`` (scores at the fired token) and ``S_t``."""
    return F.struct(
        F.col("s.Z_path").alias("Z_path"),
        F.col("s.Z_cov").alias("Z_cov"),
        F.col("s.J_t").alias("J_t"),
        F.col("S_t").alias("S_t"),
        F.col("s.t").cast("bigint").alias("t"),
        (F.col("s.t") / F.lit(float(max(1, max_new_tokens)))).alias("t_frac"),
        F.col("s.pS_on_set").alias("pS_on_set"),
        F.col("s.pA_on_set").alias("pA_on_set"),
    )
