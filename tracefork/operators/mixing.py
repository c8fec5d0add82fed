"""Steering arithmetic on logit pairs: one row per position with arrays ``z_s`` (specialist) and ``z_a``
(ancestor). All narrow. ``alpha`` weighs the specialist unless a name says otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefork.functions import arrays as A
from tracefork.operators.selection import one_per_key
from tracefork.plans.skew import hot_join
from tracefork.schemas import TRACE

# Fixed values of the operators.
LOG_EPS = 1e-10
PROB_MIX_FLOOR = 1e-12
SIGMOID_CLAMP = 4.6
STEER_ALPHA = 0.7
GREEDY_TEMPERATURE = 1e-5
MIXES = ("logit_mix", "prob_mix", "adaptive_logit_mix", "adaptive_prob_mix")


def aligned(z_s: Column, z_a: Column) -> Column:
    """The ancestor cut or padded with -inf to the specialist's vocabulary."""
    return A.resize(z_a, z_s)


def entropy_gap(z_s: Column, z_a: Column) -> Column:
    return A.entropy(A.softmax(z_s), LOG_EPS) - A.entropy(A.softmax(z_a), LOG_EPS)


def chi2(z_s: Column, z_a: Column) -> Column:
    ratio = F.zip_with(A.softmax(z_a), A.softmax(z_s), lambda a, s: a * a / (s + F.lit(LOG_EPS)))
    return A.asum(ratio) - 1.0


def adaptive_alpha(signal: Column, temperature: float = 1.0, base_alpha: float = STEER_ALPHA) -> Column:
    bias = math.log(base_alpha / (1.0 - base_alpha))
    x = F.greatest(F.lit(-SIGMOID_CLAMP), F.least(F.lit(SIGMOID_CLAMP), signal / F.lit(float(temperature)) + F.lit(bias)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _keep_protected(mixed: Column, original: Column, protected: Sequence[int]) -> Column:
    if not protected:
        return mixed
    ids = [int(p) for p in protected]
    return A.let(original, lambda o: F.transform(mixed, lambda x, i: F.when(i.isin(ids), F.get(o, i)).otherwise(x)))


def logit_mix(z_s: Column, z_a: Column, alpha: float | Column, protected: Sequence[int] = ()) -> Column:
    """alpha z_S + (1 - alpha) z_A; the end points return one model untouched."""
    if not isinstance(alpha, Column):
        if alpha == 0.0:
            return _keep_protected(z_a, z_s, protected)
        if alpha == 1.0:
            return z_s
        alpha = F.lit(float(alpha))
    mixed = A.let(alpha, lambda a: F.zip_with(z_s, z_a, lambda s, b: a * s + (F.lit(1.0) - a) * b))
    return _keep_protected(mixed, z_s, protected)


def prob_mix(
    z_s: Column,
    z_a: Column,
    alpha: float | Column,
    temperature: float = 1.0,
    floor: float = PROB_MIX_FLOOR,
    protected: Sequence[int] = (),
    rescale: bool = False,
    additive: bool = False,
) -> Column:
    """ln(max(alpha p_S + (1 - alpha) p_A, floor)), optionally times the temperature.

    ``additive`` adds the floor instead of clamping. A vanishing temperature falls back to logits.
    """
    if rescale and temperature < GREEDY_TEMPERATURE:
        return logit_mix(z_s, z_a, alpha, protected)
    a_col = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    p_s = A.softmax(z_s, temperature)
    mixed = A.let(
        a_col, lambda a: F.zip_with(p_s, A.softmax(z_a, temperature), lambda s, b: a * s + (F.lit(1.0) - a) * b)
    )
    mixed = _keep_protected(mixed, p_s, protected)
    scale = F.lit(float(temperature)) if rescale else F.lit(1.0)
    if additive:
        return F.transform(mixed, lambda p: scale * F.log(p + F.lit(floor)))
    return F.transform(mixed, lambda p: scale * F.log(F.greatest(p, F.lit(floor))))


def adaptive_logit_mix(z_s: Column, z_a: Column, temperature: float = 1.0) -> Column:
    return logit_mix(z_s, z_a, adaptive_alpha(-entropy_gap(z_s, z_a), temperature))


def adaptive_prob_mix(z_s: Column, z_a: Column, temperature: float = 1.0) -> Column:
    return prob_mix(z_s, z_a, adaptive_alpha(-chi2(z_s, z_a), temperature), floor=LOG_EPS, additive=True)


def steer(tau: Column, z_s: Column, z_a: Column, alpha: float = STEER_ALPHA, temperature: float = 0.6) -> Column:
    """The direction-specific mix: logits for 'path', probabilities for 'cov'."""
    return F.when(tau == "path", logit_mix(z_s, z_a, alpha)).otherwise(
        prob_mix(z_s, z_a, alpha, temperature)
    )


def mixing_diagnostics(pairs: DataFrame, alpha: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mean entropies and the spread of alpha. Here alpha weighs the ancestor, as the definition has it."""
    p_s, p_a = A.softmax(F.col("z_s")), A.softmax(F.col("z_a"))
    mix = A.let(F.col("_alpha"), lambda a: F.zip_with(p_a, p_s, lambda b, s: a * b + (F.lit(1.0) - a) * s))
    rows = pairs.withColumn("_alpha", alpha).select(
        *keys,
        A.entropy(p_a, LOG_EPS).alias("h_a"),
        A.entropy(p_s, LOG_EPS).alias("h_s"),
        A.entropy(mix, LOG_EPS).alias("h_m"),
        "_alpha",
    )
    return rows.groupBy(*keys).agg(
        F.avg("h_a").alias("H_anc"),
        F.avg("h_s").alias("H_spec"),
        F.avg("h_m").alias("H_mix"),
        F.avg("_alpha").alias("alpha_mean"),
        F.stddev_samp("_alpha").alias("alpha_std"),
        F.avg((F.col("_alpha") > 0.5).cast("double")).alias("frac_dominant"),
    )


def cross_vocabulary(z_s: Column, z_a: Column, vocab_map: Column, ancestor_weight: float) -> Column:
    """Inject ancestor logits through a specialist-to-ancestor id map (-1 = unmapped).

    Weight 1 or more replaces (unmapped become -inf); below 1 blends and leaves unmapped ids alone. Without ancestor
    logits or a map the specialist's logits stand.
    """
    def mapped(ids: Column, anc: Column) -> Column:
        return F.transform(
            ids,
            lambda m: F.get(anc, F.greatest(F.lit(0), F.least(m, F.size(anc) - 1)).cast("int")),
        )

    w = float(ancestor_weight)
    looked_up = A.let(z_a, lambda anc: mapped(vocab_map, anc))
    if w >= 1.0:
        replaced = F.zip_with(looked_up, vocab_map, lambda v, m: F.when(m == -1, F.lit(A.NEG_INF)).otherwise(v))
        return F.coalesce(F.when(z_a.isNotNull(), replaced), z_s)
    both = F.zip_with(z_s, looked_up, lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    blended = F.zip_with(
        both,
        vocab_map,
        lambda e, m: F.when(m == -1, e["s"]).otherwise(F.lit(1.0 - w) * e["s"] + F.lit(w) * e["v"]),
    )
    return F.coalesce(F.when(z_a.isNotNull(), blended), z_s)


def proxy_tune(target: Column, expert: Column, base: Column, alpha: float = 1.0) -> Column:
    """target + alpha (expert - base)."""
    shift = F.zip_with(expert, base, lambda e, b: F.lit(float(alpha)) * (e - b))
    return F.zip_with(target, shift, lambda t, d: t + d)


def min_p(z: Column, threshold: float) -> Column:
    """Set tokens below ``threshold * max p`` to -inf."""
    return A.let(
        A.softmax(z),
        lambda p: A.let(
            F.array_max(p) * F.lit(float(threshold)),
            lambda cut: F.zip_with(z, p, lambda x, q: F.when(q < cut, F.lit(A.NEG_INF)).otherwise(x)),
        ),
    )


def top_p(z: Column, threshold: float) -> Column:
    """Set tokens after the one whose cumulative probability first exceeds ``threshold`` to -inf.

    The sorted prefix is folded once to find the last kept (p, -index); ties go to the smaller index.
    """
    limit = F.lit(float(threshold))

    def kept_from(p: Column) -> Column:
        entries = F.sort_array(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("n"))), asc=False)
        start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("p"), F.lit(0).alias("n"))
        return F.aggregate(
            entries,
            start,
            lambda acc, e: F.when(
                acc["cum"] <= limit,
                F.struct((acc["cum"] + e["p"]).alias("cum"), e["p"].alias("p"), e["n"].alias("n")),
            ).otherwise(acc),
        )

    return A.let(
        A.softmax(z),
        lambda p: A.let(
            kept_from(p),
            lambda last: A.let(
                p,
                lambda q: F.transform(
                    z,
                    lambda x, i: F.when(
                        (F.get(q, i) > last["p"]) | ((F.get(q, i) == last["p"]) & (-i >= last["n"])), x
                    ).otherwise(F.lit(A.NEG_INF)),
                ),
            ),
        ),
    )


def repetition_penalty(z: Column, seen: Column, penalty: float) -> Column:
    """Seen ids: positive logits divided by the penalty, others multiplied."""
    r = F.lit(float(penalty))
    return A.let(
        seen,
        lambda ids: F.transform(
            z,
            lambda x, i: F.when(F.array_contains(ids, i.cast("bigint")), F.when(x > 0, x / r).otherwise(x * r)).otherwise(x),
        ),
    )


def with_seen(steps: DataFrame, sequences: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """``steps`` with ``seen``: the distinct ids of the rollout's prompt and of its tokens before ``t``.

    A rollout without a prompt has only its own tokens; one without a sequence has only its prompt. The array is bounded
    by the model's context.
    """
    none = F.array().cast("array<bigint>")
    out = hot_join(steps, sequences.select(*TRACE, F.col("output_ids").cast("array<bigint>").alias("_own")), TRACE, ["t"], "left")
    own = F.when(F.col("t") > 0, F.slice(F.coalesce("_own", none), F.lit(1), F.col("t").cast("int"))).otherwise(none)
    if prompts is None:
        return out.withColumn("seen", F.array_distinct(own)).drop("_own")
    ids = prompts.select("pid", F.col("prompt_ids").cast("array<bigint>").alias("_prompt"))
    out = hot_join(out, one_per_key(ids, ["pid"]), ["pid"], ["rollout_idx", "t"], "left", counted=steps)
    return out.withColumn("seen", F.array_distinct(F.concat(F.coalesce("_prompt", none), own))).drop("_own", "_prompt")


def in_window(step: Column, start: Column, width: int) -> Column:
    return (step >= start) & (step < start + width)


def inject(
    pairs: DataFrame,
    junctions: DataFrame,
    mode: str,
    width: int = 1,
    alpha: float = 0.9,
    temperature: float = 1.0,
    adaptive_temperature: float = 1.0,
    sampling: bool = False,
    min_p_value: float = 0.0,
    top_p_value: float = 1.0,
    penalty: float = 1.0,
    inject_top_k: int | None = None,
) -> DataFrame:
    """Apply one injection mode inside ``[t_start, t_start + width)`` of each trace.

    Adds ``z_out`` and ``in_window``. Outside the window the specialist's logits stand (scaled for a
    greedy choice unless sampling, which leaves the argmax as it is).
    """
    if inject_top_k is not None:
        raise ValueError("inject_top_k is not supported at the injected position; use min-p or top-p")
    rows = hot_join(pairs, junctions.select(*TRACE, "t_start"), TRACE, ["t"], "left")
    inside = F.coalesce(in_window(F.col("t"), F.col("t_start"), width), F.lit(False))
    scale = 1.0 if sampling or temperature <= 0 else float(temperature)
    z_s = F.transform("z_s", lambda x: x / F.lit(scale)) if scale != 1.0 else F.col("z_s")
    z_a = aligned(F.col("z_s"), F.col("z_a"))
    z_a = F.transform(z_a, lambda x: x / F.lit(scale)) if scale != 1.0 else z_a
    modes = {
        "logit_mix": lambda: logit_mix(z_s, z_a, F.lit(float(alpha))),
        "prob_mix": lambda: prob_mix(z_s, z_a, F.lit(float(alpha)), additive=True),
        "adaptive_logit_mix": lambda: adaptive_logit_mix(z_s, z_a, adaptive_temperature),
        "adaptive_prob_mix": lambda: adaptive_prob_mix(z_s, z_a, adaptive_temperature),
        "min_p": lambda: min_p(z_s, min_p_value),
        "top_p": lambda: top_p(z_s, top_p_value),
        "reppen": lambda: repetition_penalty(z_s, F.col("seen"), penalty),
    }
    chosen = modes[mode]()
    if mode in MIXES:  # without ancestor logits the specialist's stand
        chosen = F.when(F.col("z_a").isNotNull(), chosen)
    outside = F.col("z_s") if sampling else F.transform("z_s", lambda x: x * F.lit(100.0))
    return rows.withColumn("in_window", inside).withColumn(
        "z_out", F.when(F.col("in_window"), F.coalesce(chosen, z_s)).otherwise(outside)
    )
