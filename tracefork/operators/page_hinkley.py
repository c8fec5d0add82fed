"""Page-Hinkley change detection on per-token signals, in batch.

The running mean and the excess sum are folds along a trace. A trace is folded in blocks of bounded
length: a block that is its whole trace (the usual case) is done at once; for longer traces each block
is summed up as a linear map of the mean and a clipped-shift map of the excess, the maps are chained per
trace, and every block is folded again from its true starting state. So one very long trace is spread
over tasks and never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefork.schemas import TRACE
from tracefork.session import durable

# Fixed values of the detector and its calibration.
BETA = 0.05
MIN_STEP = 20
TARGET_FAR = 0.05
LAMBDA_GRID = [0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 16.0, 20.0, 25.0, 30.0]
BLOCK = 4096


def warmup_steps(beta: float = BETA) -> int:
    return math.ceil(1.0 / beta)


def first_armed_step(beta: float, min_step: int) -> int:
    """0-based step from which the online detector accumulates: its counter is 1-based."""
    return max(warmup_steps(beta) - 1, min_step)


def _double(value) -> Column:
    return F.lit(value).cast("double")


def _next_mu(mu: Column, x: Column, beta: float) -> Column:
    return F.lit(1 - beta) * mu + F.lit(beta) * x


def _entry_mu() -> Column:
    """The mean before ``_steps()``: the first value of a trace starts its own mean."""
    return F.coalesce(F.col("mu0"), F.get("xs", F.lit(0))["x"])


def _steps() -> Column:
    return F.when(F.col("mu0").isNull(), F.slice("xs", F.lit(2), F.size("xs"))).otherwise(F.col("xs"))


def blocks_of(steps: DataFrame, signal: str, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """Arrays of at most ``block`` consecutive signal values; steps are numbered 0,1,2,… per trace.

    ``carry`` names columns that are constant along a trace.
    """
    number = F.floor(F.col("t") / block).cast("bigint")
    return (
        steps.select(*TRACE, *carry, number.alias("block"), "t", F.col(signal).alias("x"))
        .groupBy(*TRACE, *carry, "block")
        .agg(F.sort_array(F.collect_list(F.struct("t", F.col("x").cast("double").alias("x")))).alias("xs"))
        .withColumn("n", F.size("xs"))
    )


def _advance(acc: Column, e: Column, armed: int, beta: float) -> tuple[Column, Column]:
    """(mean, excess) after one more step; the excess stands still until armed.

    The mean is spelled out twice rather than bound: it is two multiplications.
    """
    mu = _next_mu(acc["mu"], e["x"], beta)
    g = F.when(e["t"] >= armed, F.greatest(_double(0.0), acc["g"] + (e["x"] - mu))).otherwise(acc["g"])
    return mu, g


def _fold_max(armed: int, beta: float) -> Column:
    """Largest excess within a block begun at ``(mu0, g0)``."""
    start = F.struct(_entry_mu().alias("mu"), F.col("g0").alias("g"), _double(0.0).alias("top"))

    def step(acc: Column, e: Column) -> Column:
        mu, g = _advance(acc, e, armed, beta)
        return F.struct(mu.alias("mu"), g.alias("g"), F.greatest(acc["top"], g).alias("top"))

    return F.aggregate(_steps(), start, step, lambda acc: acc["top"])


def _fold_fire(lam: Column, armed: int, beta: float) -> Column:
    """State at the first step of a block where the excess passes ``lam``; null if none does.

    The fold freezes once it has fired.
    """
    start = F.struct(
        _entry_mu().alias("mu"),
        F.col("g0").alias("g"),
        F.lit(None).cast("bigint").alias("step"),
        _double(None).alias("x"),
    )

    def step(acc: Column, e: Column) -> Column:
        mu, g = _advance(acc, e, armed, beta)
        moved = F.struct(mu.alias("mu"), g.alias("g"), e["t"].alias("step"), e["x"].alias("x"))
        return F.when(fired(acc), acc).otherwise(moved)

    def fired(acc: Column) -> Column:
        return acc["step"].isNotNull() & (acc["g"] > lam)

    return F.aggregate(_steps(), start, step, lambda acc: F.when(fired(acc), acc))


def _start_states(blocks: DataFrame, armed: int, beta: float, block: int) -> DataFrame:
    """Add ``mu0`` and ``g0``, the state in which each block of a long trace begins.

    Only block summaries (one small row per block) meet per trace, in streaming windows.
    """
    order = W.partitionBy(*TRACE).orderBy("block")
    # The mean: each block maps mu to decay * mu + b, and every block but the last is full, so the start
    # of a block is a geometric sum over the blocks before it. Terms below 1e-20 are beyond a double.
    decay = (1 - beta) ** block
    reach = max(1, math.ceil(math.log(1e-20) / math.log(decay))) if decay > 0 else 1
    end_from = F.aggregate(_steps(), _entry_mu(), lambda mu, e: _next_mu(mu, e["x"], beta))
    own = blocks.withColumn("mu0", F.when(F.col("block") > 0, _double(0.0)))
    earlier = F.collect_list("b").over(order.rowsBetween(-reach, -1))
    mu0 = F.when(F.col("block") > 0, F.aggregate(earlier, _double(0.0), lambda mu, b: mu * F.lit(decay) + b))
    starts = own.select(*TRACE, "block", end_from.alias("b")).select(*TRACE, "block", mu0.alias("mu0"))
    with_mu = blocks.join(starts, [*TRACE, "block"])
    # The excess: each block maps g to max(a, g + b); chained through prefix sums and a running maximum.
    init = F.struct(_entry_mu().alias("mu"), _double(0.0).alias("a"), _double(0.0).alias("b"))

    def shift(acc: Column, e: Column) -> Column:
        mu = _next_mu(acc["mu"], e["x"], beta)
        on = e["t"] >= armed
        return F.struct(
            mu.alias("mu"),
            F.when(on, F.greatest(_double(0.0), acc["a"] + (e["x"] - mu))).otherwise(acc["a"]).alias("a"),
            F.when(on, acc["b"] + (e["x"] - mu)).otherwise(acc["b"]).alias("b"),
        )

    before = order.rowsBetween(W.unboundedPreceding, -1)
    maps = (
        with_mu.select(*TRACE, "block", F.aggregate(_steps(), init, shift).alias("s"))
        .select(*TRACE, "block", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
        .withColumn("p", F.coalesce(F.sum("b").over(before), _double(0.0)))
        .withColumn("m", F.coalesce(F.max(F.col("a") - F.col("p") - F.col("b")).over(before), _double(0.0)))
        .select(*TRACE, "block", (F.col("p") + F.greatest(F.col("m"), _double(0.0))).alias("g0"))
    )
    return with_mu.join(maps, [*TRACE, "block"])


def _fold_end(armed: int, beta: float) -> Column:
    """(mean, excess) after a block begun at ``(mu0, g0)``."""
    start = F.struct(_entry_mu().alias("mu"), F.col("g0").alias("g"))

    def step(acc: Column, e: Column) -> Column:
        mu, g = _advance(acc, e, armed, beta)
        return F.struct(mu.alias("mu"), g.alias("g"))

    return F.aggregate(_steps(), start, step)


def _chained(blocks: DataFrame, armed: int, beta: float, block: int) -> DataFrame:
    """``blocks`` with the states ``mu0``, ``g0`` in which one fold over the whole trace enters them.

    Between rounds one narrow row per block is kept, and only blocks that began wrongly are folded again. Each round
    settles at least the first wrong block of every trace.
    """
    key = [*TRACE, "block"]
    order = W.partitionBy(*TRACE).orderBy("block")

    def ended(begun: DataFrame) -> DataFrame:
        return begun.select(*key, "mu0", "g0", _fold_end(armed, beta).alias("end"))

    states = durable(ended(_start_states(blocks, armed, beta, block)))
    while True:
        due = F.lag("end").over(order)
        linked = states.withColumns({"due_mu": due["mu"], "due_g": due["g"]})
        wrong = durable(
            linked.where((F.col("block") > 0) & ~(F.col("mu0").eqNullSafe(F.col("due_mu")) & F.col("g0").eqNullSafe(F.col("due_g"))))
            .select(*key, F.col("due_mu").alias("mu0"), F.col("due_g").alias("g0"))
        )
        if wrong.isEmpty():
            return blocks.join(states.select(*key, "mu0", "g0"), key)
        again = ended(blocks.join(wrong, key))
        states = durable(states.join(wrong.select(*key), key, "left_anti").unionByName(again))


def fold_traces(
    steps: DataFrame,
    signal: str,
    lam: float,
    armed: int,
    beta: float = BETA,
    block: int = BLOCK,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per trace: ``g_max`` and the first crossing (``step, g_at_fire, mu_at_fire, signal_at_fire``)."""
    # Written once: the long branch reads the blocks several times.
    blocks = durable(blocks_of(steps, signal, block, carry))
    whole = (F.col("block") == 0) & (F.col("n") < block)

    def folded(states: DataFrame) -> DataFrame:
        top, fire = _fold_max(armed, beta), _fold_fire(_double(lam), armed, beta)
        return states.select(*TRACE, *carry, "block", top.alias("g_max"), fire.alias("r"))

    traces = folded(blocks.where(whole).withColumns({"mu0": _double(None), "g0": _double(0.0)})).drop("block")
    long = blocks.where(~whole)
    if not long.isEmpty():
        first = F.min_by("r", F.when(F.col("r").isNotNull(), F.col("block")))
        per_trace = folded(_chained(long, armed, beta, block)).groupBy(*TRACE, *carry)
        traces = traces.unionByName(per_trace.agg(F.max("g_max").alias("g_max"), first.alias("r")))
    return traces.select(
        *TRACE,
        *carry,
        "g_max",
        F.col("r.step").alias("step"),
        F.col("r.g").alias("g_at_fire"),
        F.col("r.mu").alias("mu_at_fire"),
        F.col("r.x").alias("signal_at_fire"),
    )


SIGNALS = {"demotion": "d_t", "coverage": "c_t"}


def detect(
    steps: DataFrame,
    lam: float,
    beta: float = BETA,
    min_step: int = MIN_STEP,
    signal_type: str = "demotion",
    block: int = BLOCK,
) -> DataFrame:
    """The online detector over whole traces; one row per trace that fires."""
    armed = first_armed_step(beta, min_step)
    return (
        fold_traces(steps, SIGNALS[signal_type], lam, armed, beta, block)
        .where(F.col("step").isNotNull())
        .drop("g_max")
    )


def excess_maxima(
    steps: DataFrame, beta: float = BETA, signal: str = "d_t", block: int = BLOCK, carry: Sequence[str] = ()
) -> DataFrame:
    """Largest excess per trace, as calibration counts it (armed from ``t >= warmup``)."""
    folded = fold_traces(steps, signal, float("inf"), warmup_steps(beta), beta, block, carry)
    return folded.select(*TRACE, *carry, "g_max")


def exceedance_curves(maxima: DataFrame, grid: Sequence[float] = tuple(LAMBDA_GRID)) -> DataFrame:
    """``far`` over correct and ``tpr`` over failed traces of ``maxima(…, is_correct, g_max)``, per lambda.

    The fraction of a population whose maximum exceeds lambda; 0 for an empty one. All counts come from
    one aggregate, then one row per lambda.
    """
    groups = {"far": F.col("is_correct"), "tpr": ~F.col("is_correct")}
    counts = [F.count_if(member).alias(f"n_{g}") for g, member in groups.items()]
    over = [
        F.count_if(member & (F.col("g_max") > lam)).alias(f"{g}_{i}")
        for g, member in groups.items()
        for i, lam in enumerate(grid)
    ]
    rows = F.array(
        *[
            F.struct(F.lit(float(lam)).alias("lam"), *[F.col(f"{g}_{i}").alias(g) for g in groups])
            for i, lam in enumerate(grid)
        ]
    )
    share = [F.coalesce(F.try_divide(F.col(f"e.{g}"), F.col(f"n_{g}")), F.lit(0.0)).alias(g) for g in groups]
    table = maxima.agg(*counts, *over).select("n_far", "n_tpr", F.explode(rows).alias("e"))
    return table.select(F.col("e.lam").alias("lam"), *share, "n_far", "n_tpr")


def calibrate_far(curves: DataFrame, target: float = TARGET_FAR) -> DataFrame:
    """Smallest lambda within the false-alarm budget; the largest (flagged) if none or no traces."""
    ok = (F.col("far") <= target) & (F.col("n_far") > 0)
    return curves.agg(
        F.min(F.when(ok, F.col("lam"))).alias("best"), F.max("lam").alias("limit"), F.max("n_far").alias("n_correct")
    ).select(
        F.coalesce("best", "limit").alias("chosen_lam"), F.col("best").isNull().alias("lam_at_limit"), "n_correct"
    )


def calibrate_joint(curves: DataFrame, target: float = TARGET_FAR) -> DataFrame:
    """Largest TPR - FAR within the budget, ties to the smaller lambda; largest lambda if infeasible."""
    ok = (F.col("far") <= target) & (F.col("n_far") > 0) & (F.col("n_tpr") > 0)
    best = F.max(F.when(ok, F.struct((F.col("tpr") - F.col("far")).alias("j"), (-F.col("lam")).alias("neg"))))
    return curves.agg(
        best.alias("best"),
        F.max("lam").alias("limit"),
        F.max("n_far").alias("n_correct"),
        F.max("n_tpr").alias("n_fail"),
    ).select(
        F.coalesce(-F.col("best.neg"), F.col("limit")).alias("chosen_lam"),
        F.col("best").isNull().alias("lam_at_limit"),
        F.coalesce(F.col("best.j"), F.lit(float("nan"))).alias("youdens_j"),
        "n_correct",
        "n_fail",
    )
