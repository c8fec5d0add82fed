"""Per-token divergence features from top-K log-probabilities of a specialist (S) and an ancestor (A).

One exchange carries the long table to its positions; pairing the two models and all ten features are
two hash aggregates on that same partitioning. Weighted moments and information quantities are closed
forms of per-position sums, so no second pass over the K rows and no window is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefork.functions import arrays as A
from tracefork.plans.skew import salted_join
from tracefork.schemas import CACHE_ARRAYS, TRACE

# Fixed values of the feature definitions.
LOG_FLOOR = -1000.0
MASS_EPS = 1e-8
TEMPERATURE = 0.6
COVERAGE_K = 20
KL_K = 100

PLACE = [*TRACE, "pos"]


def fill_ranks(topk: DataFrame, k_cov: int = COVERAGE_K) -> DataFrame:
    """Rank the entries of every position where no rank within ``k_cov`` was delivered."""
    place = W.partitionBy(*PLACE, "model")
    by_logprob = place.orderBy(F.col("logprob").desc(), "token_id")
    usable = F.max(F.when(F.col("rank") <= k_cov, 1)).over(place)
    return topk.withColumn("rank", F.when(usable.isNull(), F.row_number().over(by_logprob)).otherwise(F.col("rank")))


def pair_models(topk: DataFrame, taken: DataFrame, ranks: str = "fill", k_cov: int = COVERAGE_K) -> DataFrame:
    """One row per (position, token) with both models' log-probabilities and the taken-token flag.

    The taken tokens join in as extra rows of the same aggregate instead of a second shuffle. A
    position without a taken token, or without either model, is skipped later.
    ``ranks="trusted"`` says that every position carries ranks and saves the sort that fills them.
    """
    entries = topk.select(*PLACE, "model", F.col("token_id").alias("token"), "logprob", "rank")
    marks = taken.select(
        *PLACE,
        F.lit("X").alias("model"),
        F.col("x_t").alias("token"),
        F.lit(None).cast("double").alias("logprob"),
        F.lit(None).cast("bigint").alias("rank"),
        "t",
    )
    rows = entries.withColumn("t", F.lit(None).cast("bigint")).unionByName(marks).repartition(*PLACE)
    if ranks == "fill":
        rows = fill_ranks(rows.withColumnRenamed("token", "token_id"), k_cov).withColumnRenamed("token_id", "token")

    def of(model: str, value: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(value)))

    return rows.groupBy(*PLACE, "token").agg(
        F.greatest(of("S", "logprob"), F.when(of("S", "logprob").isNotNull(), F.lit(LOG_FLOOR))).alias("l_s"),
        F.greatest(of("A", "logprob"), F.when(of("A", "logprob").isNotNull(), F.lit(LOG_FLOOR))).alias("l_a"),
        of("A", "rank").alias("rank_a"),
        F.max("t").alias("t"),
    )


def features_of_pairs(pairs: DataFrame, temperature: float = TEMPERATURE, k_cov: int = COVERAGE_K) -> DataFrame:
    """All per-token features at decode temperature; one row per generated position."""
    T = F.lit(float(temperature))
    l_s, l_a, floor = F.col("l_s"), F.col("l_a"), F.lit(LOG_FLOOR)
    # Weights are relative to the position's largest log-probability, so a sum is never 0 however low T is.
    place = W.partitionBy(*PLACE)
    pairs = pairs.withColumns({"top_s": F.max("l_s").over(place), "top_a": F.max("l_a").over(place)})
    top_s, top_a = F.col("top_s"), F.col("top_a")
    w_s, w_a = F.exp((l_s - top_s) / T), F.exp((l_a - top_a) / T)
    in_set = F.col("rank_a") <= k_cov
    is_taken = F.col("t").isNotNull()
    s = (
        pairs.groupBy(*PLACE)
        .agg(
            F.max("t").alias("t"),
            F.max(F.when(is_taken, F.col("token"))).alias("x_t"),
            F.count("l_s").alias("k_s"),
            F.count("l_a").alias("k_a"),
            F.sum(w_s).alias("z_s"),
            F.sum(w_a).alias("z_a"),
            F.coalesce(F.max(F.when(is_taken, l_s)), floor).alias("taken_s"),
            F.coalesce(F.max(F.when(is_taken, l_a)), floor).alias("taken_a"),
            F.sum(w_s * l_s).alias("r1"),
            F.sum(w_s * l_s * l_s).alias("r2"),
            F.sum(w_s * l_s * l_s * l_s).alias("r3"),
            F.sum(w_s * l_s * l_s * l_s * l_s).alias("r4"),
            F.sum(w_s * F.coalesce(l_a, floor)).alias("cross"),
            F.sum(F.when(in_set, w_a)).alias("set_a"),
            F.sum(F.when(in_set, F.exp((F.coalesce(l_s, floor) - top_s) / T))).alias("set_s"),
            F.max("top_s").alias("top_s"),
            F.max("top_a").alias("top_a"),
        )
        .where(F.col("t").isNotNull() & (F.col("k_s") > 0) & (F.col("k_a") > 0))
    )
    s = s.select(
        *TRACE,
        "pos",
        "t",
        "x_t",
        (F.log("z_s") + top_s / T).alias("lse_s"),
        (F.log("z_a") + top_a / T).alias("lse_a"),
        "taken_s",
        "taken_a",
        (F.col("r1") / F.col("z_s")).alias("m1"),
        (F.col("r2") / F.col("z_s")).alias("m2"),
        (F.col("r3") / F.col("z_s")).alias("m3"),
        (F.col("r4") / F.col("z_s")).alias("m4"),
        (F.col("cross") / F.col("z_s")).alias("cross"),
        (F.coalesce("set_a", F.lit(0.0)) / F.col("z_a")).alias("pA_on_set"),
        (F.coalesce("set_s", F.lit(0.0)) / F.col("z_s")).alias("pS_on_set"),
    )
    m1, m2, m3, m4 = (F.col(f"m{i}") for i in range(1, 5))
    log_ps = F.col("taken_s") / T - F.col("lse_s")
    log_pa = F.col("taken_a") / T - F.col("lse_a")
    variance = F.greatest(m2 - m1 * m1, F.lit(0.0))
    fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    ent = F.col("lse_s") - m1 / T
    s = s.select(
        *TRACE,
        "pos",
        "t",
        "x_t",
        "lse_s",
        "lse_a",
        (log_ps - log_pa).alias("Delta_path"),
        F.exp(log_ps).alias("V"),
        variance.alias("logit_var"),
        (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1).alias("logit_skew"),
        (fourth - 3 * variance * variance).alias("logit_kurt"),
        ent.alias("entropy"),
        F.greatest(-ent - F.col("cross") / T + F.col("lse_a"), F.lit(0.0)).alias("kl_div"),
        "pA_on_set",
        "pS_on_set",
        F.log((F.col("pA_on_set") + MASS_EPS) / (F.col("pS_on_set") + MASS_EPS)).alias("G_cov"),
    )
    return s.withColumn(
        "J_approx", F.greatest("Delta_path", F.lit(0.0)) + F.greatest("G_cov", F.lit(0.0))
    )


def token_features(
    topk: DataFrame,
    taken: DataFrame,
    temperature: float = TEMPERATURE,
    k_cov: int = COVERAGE_K,
    ranks: str = "fill",
) -> DataFrame:
    return features_of_pairs(pair_models(topk, taken, ranks, k_cov), temperature, k_cov)


def renormalised(pairs: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """The specialist's renormalised top-K probabilities, one row per (position, token)."""
    top = F.max("l_s").over(W.partitionBy(*PLACE))
    p = F.exp((F.col("l_s") - top) / F.lit(float(temperature)))
    total = F.sum(p).over(W.partitionBy(*PLACE))
    return pairs.where(F.col("l_s").isNotNull()).select(*PLACE, "token", (p / total).alias("p"))


def coverage_set(topk: DataFrame, k_cov: int = COVERAGE_K) -> DataFrame:
    """The ancestor's top ``k_cov`` tokens per position."""
    ancestor = topk.where(F.col("model") == "A")
    return fill_ranks(ancestor, k_cov).where(F.col("rank") <= k_cov)


def assemble_traces(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per rollout with aligned arrays in token order (bounded by the context length)."""
    names = names or CACHE_ARRAYS
    steps = F.sort_array(F.collect_list(F.struct("t", *names)))
    packed = features.groupBy(*TRACE).agg(steps.alias("steps"))
    return packed.select(*TRACE, *[F.col("steps").getField(n).alias(n) for n in names])


def explode_traces(traces: DataFrame, names: list[str]) -> DataFrame:
    """Back to one row per token; ``t`` is the array index."""
    zipped = F.arrays_zip(*[F.col(n) for n in names])
    keep = [c for c in traces.columns if c not in CACHE_ARRAYS]
    return traces.select(*keep, F.posexplode(zipped).alias("t", "e")).select(
        *keep, F.col("t").cast("bigint").alias("t"), *[F.col("e").getField(n).cast("double").alias(n) for n in names]
    )


def capture_topk(topk: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Raw capture: per rollout and model the [L, K] log-probability and id matrices.

    Short positions are padded with the floor and -1 up to the longest position of that rollout.
    """
    entry = F.sort_array(F.collect_list(F.struct("rank", "token_id", "logprob")))
    rows = topk.groupBy(*TRACE, "pos", "model").agg(entry.alias("e"))
    traces = rows.groupBy(*TRACE, "model").agg(
        F.sort_array(F.collect_list(F.struct("pos", "e"))).alias("rows"), F.max(F.size("e")).alias("k")
    )

    def padded(field: str, fill: Column) -> Column:
        return F.transform(
            "rows",
            lambda r: F.concat(r["e"].getField(field), F.array_repeat(fill, F.col("k") - F.size(r["e"]))),
        )

    return traces.select(
        *TRACE,
        "model",
        F.transform("rows", lambda r: r["pos"]).alias("positions"),
        padded("logprob", F.lit(LOG_FLOOR)).alias("topk_logprobs"),
        padded("token_id", F.lit(-1).cast("bigint")).alias("topk_token_ids"),
        F.lit(float(temperature)).alias("T_extracted"),
    )


def capture_blocks(topk: DataFrame, temperature: float = TEMPERATURE, rows: int = 256) -> DataFrame:
    """Raw capture of the positions that both models have, in blocks of at most ``rows`` of them.

    One row for each rollout, block and model: the ``positions``, and row after row the ``k`` entries of each in flat
    arrays, in the order of their ranks, short rows filled with the floor and -1. Both models' blocks hold the same
    positions. No row grows with the length of a trace.
    """
    entry = F.struct("rank", F.col("token_id").cast("int").alias("token_id"), F.col("logprob").cast("float").alias("logprob"))
    sides = [F.sort_array(F.collect_list(F.when(F.col("model") == m, entry))).alias(m) for m in "SA"]
    both = topk.groupBy(*TRACE, "pos").agg(*sides).where((F.size("S") > 0) & (F.size("A") > 0))
    number = F.row_number().over(W.partitionBy(*TRACE).orderBy("pos")) - 1
    block = F.floor(number / F.lit(rows)).cast("bigint").alias("block")
    packed = both.select("*", block).groupBy(*TRACE, "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "S", "A"))).alias("r"), *[F.max(F.size(m)).alias(f"k{m}") for m in "SA"]
    )

    def flat(model: str, field: str, fill: Column) -> Column:
        width = F.col(f"k{model}")
        own = lambda x: F.transform(x[model], lambda e: e[field])
        return F.flatten(F.transform("r", lambda x: F.concat(own(x), F.array_repeat(fill, width - F.size(x[model])))))

    sides = [
        F.struct(
            F.lit(m).alias("model"),
            F.col(f"k{m}").alias("k"),
            flat(m, "logprob", F.lit(LOG_FLOOR).cast("float")).alias("topk_logprobs"),
            flat(m, "token_id", F.lit(-1)).alias("topk_token_ids"),
        )
        for m in "SA"
    ]
    return packed.select(
        *TRACE, "block", F.transform("r", lambda x: x["pos"]).alias("positions"),
        F.lit(float(temperature)).alias("T_extracted"), F.explode(F.array(*sides)).alias("m"),
    ).select(*TRACE, "block", "m.model", "m.k", "positions", "m.topk_logprobs", "m.topk_token_ids", "T_extracted")


def capture_entries(blocks: DataFrame) -> DataFrame:
    """One row for each cell of the captured matrices: ``pos, slot, token_id, logprob``; filled cells have -1."""
    cells = blocks.select(*TRACE, "model", "k", "positions", F.posexplode(F.arrays_zip("topk_token_ids", "topk_logprobs")).alias("i", "c"))
    return cells.select(
        *TRACE,
        "model",
        F.get("positions", F.floor(F.col("i") / F.col("k")).cast("int")).alias("pos"),
        (F.col("i") % F.col("k")).cast("bigint").alias("slot"),
        F.col("c.topk_token_ids").cast("bigint").alias("token_id"),
        F.col("c.topk_logprobs").cast("double").alias("logprob"),
    )


# ---- full-vocabulary logits: one row per position, arrays z_s and z_a ----


def _log_probs(pairs: DataFrame, temperature: float) -> DataFrame:
    return pairs.withColumns(
        {"lp_s": A.log_softmax(F.col("z_s"), temperature), "lp_a": A.log_softmax(F.col("z_a"), temperature)}
    )


def full_vocab_scores(
    pairs: DataFrame, temperature: float = TEMPERATURE, k_kl: int = KL_K, k_cov: int = COVERAGE_K
) -> DataFrame:
    """Background-free scores at each position of ``logit_pairs(…, x_t, z_s, z_a)``.

    ``r_chosen, mu_r, I_r, Z_path, pS_on_set, pA_on_set, G_cov, V_t, J_approx``. Narrow: the
    arrays never leave their row.
    """
    lp = _log_probs(pairs, temperature)
    best_s = A.top_entries(F.col("lp_s"), k_kl, F.col("lp_a"), F.col("z_s"))
    best_a = A.top_entries(F.col("lp_a"), k_cov, F.col("lp_s"))
    keep = [c for c in pairs.columns if c not in ("z_s", "z_a")]

    def weighted(entries: Column, value) -> Column:
        """(sum of p, sum of p*v, sum of p*(v-mean)^2) with p renormalised over the entries."""
        return A.let(
            F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + F.exp(e["score"])) + F.lit(1e-12),
            lambda mass: A.let(
                F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + F.exp(e["score"]) / mass * value(e)),
                lambda mean: F.struct(
                    mean.alias("mean"),
                    F.aggregate(
                        entries,
                        F.lit(0.0),
                        lambda acc, e: acc + F.exp(e["score"]) / mass * (value(e) - mean) * (value(e) - mean),
                    ).alias("var"),
                ),
            ),
        )

    return (
        lp.select(
            *keep,
            (A.at(F.col("lp_s"), F.col("x_t")) - A.at(F.col("lp_a"), F.col("x_t"))).alias("r_chosen"),
            A.let(
                best_s,
                lambda e: F.struct(
                    weighted(e, lambda x: x["score"] - x["p0"]).alias("r"), weighted(e, lambda x: x["p1"]).alias("z")
                ),
            ).alias("top"),
            A.let(
                best_a,
                lambda e: F.struct(
                    F.aggregate(e, F.lit(0.0), lambda acc, x: acc + F.exp(x["score"])).alias("a"),
                    F.aggregate(e, F.lit(0.0), lambda acc, x: acc + F.exp(x["p0"])).alias("s"),
                ),
            ).alias("cov"),
        )
        .select(
            *keep,
            "r_chosen",
            F.col("top.r.mean").alias("mu_r"),
            F.col("top.r.var").alias("I_r"),
            F.col("top.z.var").alias("V_t"),
            F.col("cov.a").alias("pA_on_set"),
            F.col("cov.s").alias("pS_on_set"),
        )
        .withColumns(
            {
                "Z_path": F.greatest(
                    F.lit(0.0), (F.col("r_chosen") - F.col("mu_r")) / (F.sqrt("I_r") + F.lit(1e-6))
                ),
                "G_cov": F.log((F.col("pA_on_set") + MASS_EPS) / (F.col("pS_on_set") + MASS_EPS)),
            }
        )
        .withColumn(
            "J_approx", F.greatest("r_chosen", F.lit(0.0)) + F.greatest("G_cov", F.lit(0.0))
        )
    )


def score_against(scores: DataFrame, background: DataFrame, by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Scores relative to a problem's background: ``Z_cov, J_t, tau_t, Z_V, entropy_sensitive``."""
    bg = background.select(*by, "mu_cov", "sig_cov", "mu_logV", "sig_logV", "lambda_J", "lambda_V")
    return (
        salted_join(scores, bg, list(by), ["rollout_idx"])
        .withColumns(
            {
                "Z_cov": F.greatest(
                    F.lit(0.0), (F.col("G_cov") - F.col("mu_cov")) / (F.col("sig_cov") + F.lit(1e-6))
                ),
                "Z_V": (F.log(F.greatest("V_t", F.lit(1e-8))) - F.col("mu_logV")) / (F.col("sig_logV") + F.lit(1e-6)),
            }
        )
        .withColumns(
            {
                "J_t": F.greatest("Z_path", "Z_cov"),
                "tau_t": F.when(F.col("Z_path") >= F.col("Z_cov"), "path").otherwise("cov"),
                "entropy_sensitive": F.col("Z_V") > F.col("lambda_V"),
            }
        )
    )
