"""Queries over steering arithmetic on logit pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefork.catalog import inputs as I
from tracefork.catalog.detector_queries import MIXED, hash_sql
from tracefork.catalog.registry import pick, pick_sql, query, r6, s6
from tracefork.catalog.trace_queries import FIRED90, fired
from tracefork.functions import arrays as A
from tracefork.functions.draws import draw_between, draw_direction
from tracefork.operators import mixing as mx
from tracefork.operators import trace_features as trf
from tracefork.schemas import TRACE

KEY = ["pid", "rollout_idx", "t"]
ALPHA = 0.7
PROTECTED = [0, 5, 63]


def spread_out(df, values: Column, name: str):
    """One row per token of an array column."""
    return df.select(*KEY, F.posexplode(values).alias("token", name)).select(
        *KEY, F.col("token").cast("bigint").alias("token"), r6(name)
    )


def token_sql(expr: str, source: str = "gp", name: str = "z") -> str:
    return f"SELECT pid, rollout_idx, t, token, {s6(name, expr)} FROM {source}"


GAP = [
    *MIXED,
    """gg AS (SELECT vec_id, any_value(pid) AS pid, any_value(rollout_idx) AS rollout_idx, any_value(t) AS t,
        -sum(p_s * ln(p_s + 1e-10)) AS h_s, -sum(p_a * ln(p_a + 1e-10)) AS h_a,
        sum(p_a * p_a / (p_s + 1e-10)) - 1 AS chi2 FROM gp GROUP BY vec_id)""",
    """ga AS (SELECT *, h_s - h_a AS gap,
        1 / (1 + exp(-greatest(-4.6, least(4.6, -(h_s - h_a) + ln(0.7 / 0.3))))) AS a_gap,
        1 / (1 + exp(-greatest(-4.6, least(4.6, -chi2 + ln(0.7 / 0.3))))) AS a_chi FROM gg)""",
    "gx AS (SELECT gp.*, a_gap, a_chi FROM gp JOIN ga USING (vec_id))",
]


@query("g1_entropy_gap", I.with_sql(*GAP, f"SELECT {pick_sql(KEY, ['gap'])} FROM ga"))
def g1(spark, sf):
    return I.logit_pairs(spark, sf).select(*KEY, r6("gap", mx.entropy_gap(F.col("z_s"), F.col("z_a"))))


@query("g2_chi2", I.with_sql(*GAP, f"SELECT {pick_sql(KEY, ['chi2'])} FROM ga"))
def g2(spark, sf):
    return I.logit_pairs(spark, sf).select(*KEY, r6("chi2", mx.chi2(F.col("z_s"), F.col("z_a"))))


@query("g3_adaptive_alpha", I.with_sql(*GAP, f"SELECT {pick_sql(KEY, ['a_gap', 'a_chi'])} FROM ga"))
def g3(spark, sf):
    z = (F.col("z_s"), F.col("z_a"))
    return I.logit_pairs(spark, sf).select(
        *KEY, r6("a_gap", mx.adaptive_alpha(-mx.entropy_gap(*z))), r6("a_chi", mx.adaptive_alpha(-mx.chi2(*z)))
    )


_DIAG = ["H_anc", "H_spec", "H_mix", "alpha_mean", "alpha_std", "frac_dominant"]


@query(
    "g4_mixing_diagnostics",
    I.with_sql(
        *GAP,
        """gm AS (SELECT vec_id, -sum((a_gap * p_a + (1 - a_gap) * p_s) * ln(a_gap * p_a + (1 - a_gap) * p_s + 1e-10)) AS h_m FROM gx GROUP BY vec_id)""",
        f"""SELECT pid, {s6('H_anc', 'avg(h_a)')}, {s6('H_spec', 'avg(h_s)')}, {s6('H_mix', 'avg(h_m)')}, {s6('alpha_mean', 'avg(a_gap)')},
        {s6('alpha_std', 'stddev_samp(a_gap)')}, {s6('frac_dominant', 'avg(CASE WHEN a_gap > 0.5 THEN 1.0 ELSE 0.0 END)')}
        FROM ga JOIN gm USING (vec_id) GROUP BY pid""",
    ),
)
def g4(spark, sf):
    alpha = mx.adaptive_alpha(-mx.entropy_gap(F.col("z_s"), F.col("z_a")))
    return pick(mx.mixing_diagnostics(I.logit_pairs(spark, sf), alpha, ["pid"]), ["pid"], _DIAG)


@query("g5_logit_mix", I.with_sql(*MIXED, token_sql("0.7 * z_s + 0.3 * z_a")))
def g5(spark, sf):
    return spread_out(I.logit_pairs(spark, sf), mx.logit_mix(F.col("z_s"), F.col("z_a"), ALPHA), "z")


@query("g5_logit_mix_end_points", I.with_sql(*MIXED, f"SELECT pid, rollout_idx, t, token, {s6('only_a', 'z_a')}, {s6('only_s', 'z_s')} FROM gp"))
def g5_ends(spark, sf):
    z = (F.col("z_s"), F.col("z_a"))
    both = F.arrays_zip(mx.logit_mix(*z, 0.0).alias("a"), mx.logit_mix(*z, 1.0).alias("s"))
    rows = I.logit_pairs(spark, sf).select(*KEY, F.posexplode(both).alias("token", "e"))
    return rows.select(*KEY, F.col("token").cast("bigint").alias("token"), r6("only_a", F.col("e")["a"]), r6("only_s", F.col("e")["s"]))


AT_T = [
    *I.LOGITS,
    f"""gt AS (SELECT zl.*, xt.x_t, exp(z_s / {I.T}) / sum(exp(z_s / {I.T})) OVER (PARTITION BY zl.vec_id) AS q_s,
        exp(z_a / {I.T}) / sum(exp(z_a / {I.T})) OVER (PARTITION BY zl.vec_id) AS q_a FROM zl JOIN xt USING (vec_id))""",
]
_COV = "ln(greatest(0.7 * q_s + 0.3 * q_a, 1e-12))"


@query("g6_prob_mix", I.with_sql(*AT_T, token_sql(_COV, "gt")))
def g6(spark, sf):
    mixed = mx.prob_mix(F.col("z_s"), F.col("z_a"), ALPHA, I.TEMPERATURE)
    return spread_out(I.logit_pairs(spark, sf), mixed, "z")


@query("g6_prob_mix_rescaled", I.with_sql(*AT_T, token_sql(f"{I.TEMPERATURE} * {_COV}", "gt")))
def g6_scaled(spark, sf):
    mixed = mx.prob_mix(F.col("z_s"), F.col("z_a"), ALPHA, I.TEMPERATURE, rescale=True)
    return spread_out(I.logit_pairs(spark, sf), mixed, "z")


@query("g7_adaptive_logit_mix", I.with_sql(*GAP, token_sql("a_gap * z_s + (1 - a_gap) * z_a", "gx")))
def g7(spark, sf):
    return spread_out(I.logit_pairs(spark, sf), mx.adaptive_logit_mix(F.col("z_s"), F.col("z_a")), "z")


@query("g8_adaptive_prob_mix", I.with_sql(*GAP, token_sql("ln(a_chi * p_s + (1 - a_chi) * p_a + 1e-10)", "gx")))
def g8(spark, sf):
    return spread_out(I.logit_pairs(spark, sf), mx.adaptive_prob_mix(F.col("z_s"), F.col("z_a")), "z")


@query("g9_protected_tokens", I.with_sql(*MIXED, token_sql("CASE WHEN token IN (0, 5, 63) THEN z_s ELSE 0.7 * z_s + 0.3 * z_a END")))
def g9(spark, sf):
    mixed = mx.logit_mix(F.col("z_s"), F.col("z_a"), ALPHA, PROTECTED)
    return spread_out(I.logit_pairs(spark, sf), mixed, "z")


@query(
    "g10_vocabulary_alignment",
    I.with_sql(
        *I.LOGITS,
        """al AS (SELECT zl.*, exp(z_s) / sum(exp(z_s)) OVER (PARTITION BY vec_id) AS p_s,
        CASE WHEN token < 60 THEN exp(z_a) / sum(exp(z_a)) FILTER (token < 60) OVER (PARTITION BY vec_id) ELSE 0 END AS p_a FROM zl)""",
        token_sql("ln(greatest(0.7 * p_s + 0.3 * p_a, 1e-12))", "al"),
    ),
)
def g10(spark, sf):
    """An ancestor vocabulary of 60 padded to the specialist's 64, then mixed."""
    short = F.slice("z_a", 1, 60)
    mixed = mx.prob_mix(F.col("z_s"), mx.aligned(F.col("z_s"), short), ALPHA)
    return spread_out(I.logit_pairs(spark, sf), mixed, "z")


def vocab_map() -> Column:
    """Specialist to ancestor ids, -1 where unmapped."""
    return F.transform("z_s", lambda _, i: F.when(i % 9 == 0, F.lit(-1)).otherwise((i * 5 + 3) % 60))


CROSS = [
    *I.LOGITS,
    "za AS (SELECT vec_id, list(z_a ORDER BY token) AS za FROM zl GROUP BY vec_id)",
    """cv AS (SELECT zl.*, token % 9 = 0 AS unmapped, za[CASE WHEN token % 9 = 0 THEN 1 ELSE (token * 5 + 3) % 60 + 1 END] AS z_m
        FROM zl JOIN za USING (vec_id))""",
]


@query("g11_cross_vocabulary_blend", I.with_sql(*CROSS, token_sql("CASE WHEN unmapped THEN z_s ELSE 0.75 * z_s + 0.25 * z_m END", "cv")))
def g11(spark, sf):
    mixed = mx.cross_vocabulary(F.col("z_s"), F.col("z_a"), vocab_map(), ancestor_weight=0.25)
    return spread_out(I.logit_pairs(spark, sf), mixed, "z")


@query(
    "g11_cross_vocabulary_replace",
    I.with_sql(*CROSS, f"SELECT pid, rollout_idx, t, token, {s6('z', 'z_m')} FROM cv WHERE NOT unmapped"),
)
def g11_hard(spark, sf):
    mixed = mx.cross_vocabulary(F.col("z_s"), F.col("z_a"), vocab_map(), ancestor_weight=1.0)
    return spread_out(I.logit_pairs(spark, sf), mixed, "z").where(F.col("z") > A.NEG_INF)


@query("g12_proxy_tuning", I.with_sql(*MIXED, token_sql("z_a + 0.5 * (z_s - z_a)")))
def g12(spark, sf):
    mixed = mx.proxy_tune(F.col("z_a"), F.col("z_s"), F.col("z_a"), 0.5)
    return spread_out(I.logit_pairs(spark, sf), mixed, "z")


@query("g14_min_p", I.with_sql(*MIXED, f"SELECT pid, rollout_idx, t, token, {s6('z', 'z_s')} FROM gp QUALIFY p_s >= 0.05 * max(p_s) OVER (PARTITION BY vec_id)"))
def g14(spark, sf):
    return spread_out(I.logit_pairs(spark, sf), mx.min_p(F.col("z_s"), 0.05), "z").where(F.col("z") > A.NEG_INF)


@query(
    "g15_top_p",
    I.with_sql(
        *MIXED,
        f"""SELECT pid, rollout_idx, t, token, {s6('z', 'z_s')} FROM gp QUALIFY coalesce(sum(p_s) OVER (PARTITION BY vec_id
        ORDER BY p_s DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.9""",
    ),
)
def g15(spark, sf):
    return spread_out(I.logit_pairs(spark, sf), mx.top_p(F.col("z_s"), 0.9), "z").where(F.col("z") > A.NEG_INF)


@query(
    "g16_repetition_penalty",
    I.with_sql(
        *I.LOGITS,
        """se AS (SELECT a.vec_id, b.x_t AS token FROM xt a JOIN xt b ON a.pid = b.pid AND a.rollout_idx = b.rollout_idx AND b.t < a.t
        GROUP BY ALL)""",
        f"""SELECT pid, rollout_idx, t, zl.token, {s6('z', 'CASE WHEN se.token IS NULL THEN z_s WHEN z_s > 0 THEN z_s / 1.2 ELSE z_s * 1.2 END')}
        FROM zl LEFT JOIN se ON se.vec_id = zl.vec_id AND se.token = zl.token""",
    ),
)
def g16(spark, sf):
    """Seen tokens are those generated before the position."""
    rows = mx.with_seen(I.logit_pairs(spark, sf), I.sequences(spark, sf))
    return spread_out(rows, mx.repetition_penalty(F.col("z_s"), F.col("seen"), 1.2), "z")


@query(
    "g16_prompt_tokens_are_seen",
    I.with_sql(
        *I.LOGITS,
        """se AS (SELECT a.vec_id, b.x_t AS token FROM xt a JOIN xt b ON a.pid = b.pid AND a.rollout_idx = b.rollout_idx AND b.t < a.t
        UNION SELECT vec_id, token FROM zl WHERE token % 8 = CAST(pid AS BIGINT) % 5)""",
        f"""SELECT pid, rollout_idx, t, zl.token, {s6('z', 'CASE WHEN se.token IS NULL THEN z_s WHEN z_s > 0 THEN z_s / 1.2 ELSE z_s * 1.2 END')}
        FROM zl LEFT JOIN se ON se.vec_id = zl.vec_id AND se.token = zl.token""",
    ),
)
def g16_prompts(spark, sf):
    """The prompt's ids count as seen too; ids beyond the vocabulary have no logit."""
    eighth = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i * 8 + F.col("pid").cast("bigint") % 5)
    prompts = I.prompts(spark, sf).select("pid", eighth.alias("prompt_ids"))
    rows = mx.with_seen(I.logit_pairs(spark, sf), I.sequences(spark, sf), prompts)
    return spread_out(rows, mx.repetition_penalty(F.col("z_s"), F.col("seen"), 1.2), "z")


def junctions(spark, sf):
    return trf.junction(trf.trim(I.feature_cache(spark, sf))).select(*TRACE, F.col("junction").alias("t_start"))


@query(
    "g17_injection_window",
    I.with_sql(
        *I.TRIMMED,
        f"""SELECT pid, rollout_idx, t, token, t >= j AND t < j + 3 AS in_window,
        {s6('z', 'CASE WHEN t >= j AND t < j + 3 THEN 0.9 * (z_s / 0.8) + 0.1 * (z_a / 0.8) ELSE 100 * z_s END')}
        FROM zl JOIN jn USING (pid, rollout_idx)""",
    ),
)
def g17(spark, sf):
    """Logit mix at temperature 0.8 for three tokens from the junction on."""
    out = mx.inject(I.logit_pairs(spark, sf), junctions(spark, sf), "logit_mix", width=3, alpha=0.9, temperature=0.8)
    return out.select(*KEY, "in_window", F.posexplode("z_out").alias("token", "z")).select(
        *KEY, "in_window", F.col("token").cast("bigint").alias("token"), r6("z")
    )


@query(
    "g18_local_temperature",
    I.with_sql(
        *I.LOGITS,
        """lt AS (SELECT *, exp(z_s) / sum(exp(z_s)) OVER (PARTITION BY vec_id) AS p1,
        exp(z_s / 1.5) / sum(exp(z_s / 1.5)) OVER (PARTITION BY vec_id) AS p2 FROM zl)""",
        f"""SELECT pid, rollout_idx, t, {s6('h_before', '-sum(p1 * ln(p1 + 1e-10))')}, {s6('h_after', '-sum(p2 * ln(p2 + 1e-10))')} FROM lt GROUP BY pid, rollout_idx, t""",
    ),
)
def g18(spark, sf):
    return I.logit_pairs(spark, sf).select(
        *KEY,
        r6("h_before", A.entropy(A.softmax(F.col("z_s")), 1e-10)),
        r6("h_after", A.entropy(A.softmax(F.col("z_s"), 1.5), 1e-10)),
    )


@query(
    "g19_greedy_choice",
    I.with_sql(*AT_T, f"SELECT pid, rollout_idx, t, (array_agg(token ORDER BY {_COV} DESC, token))[1] AS token FROM gt GROUP BY pid, rollout_idx, t"),
)
def g19(spark, sf):
    mixed = mx.prob_mix(F.col("z_s"), F.col("z_a"), ALPHA, I.TEMPERATURE)
    return I.logit_pairs(spark, sf).select(*KEY, A.argmax(mixed).alias("token"))


_STEER = f"CASE WHEN tau = 'path' THEN 0.7 * z_s + 0.3 * z_a ELSE {_COV} END"


@query(
    "g20_sparse_steer",
    I.with_sql(
        *FIRED90,
        *AT_T,
        f"""SELECT gt.pid, gt.rollout_idx, gt.t, any_value(tau) AS tau_hat, any_value(gt.x_t) AS x_t,
        (array_agg(token ORDER BY {_STEER} DESC, token))[1] AS steered
        FROM gt JOIN (SELECT pid, rollout_idx, t, tau FROM fp) f ON f.pid = gt.pid AND f.rollout_idx = gt.rollout_idx AND f.t = gt.t
        GROUP BY gt.pid, gt.rollout_idx, gt.t""",
    ),
)
def g20(spark, sf):
    """The steered token at each trace's firing position."""
    hits = fired(spark, sf, 3, 0.9).select(*TRACE, F.col("t_hat").alias("t"), "tau_hat")
    rows = I.logit_pairs(spark, sf).join(hits, KEY)
    steered = A.argmax(mx.steer(F.col("tau_hat"), F.col("z_s"), F.col("z_a"), ALPHA, I.TEMPERATURE))
    return rows.select(*KEY, "tau_hat", "x_t", steered.alias("steered"))


@query(
    "g21_dense_steer",
    I.with_sql(
        *AT_T,
        f"""ds AS (SELECT pid, rollout_idx, t, any_value(x_t) AS x_t, (array_agg(token ORDER BY {_COV} DESC, token))[1] AS c,
        (array_agg(token ORDER BY 0.7 * z_s + 0.3 * z_a DESC, token))[1] AS p FROM gt GROUP BY pid, rollout_idx, t)""",
        f"""SELECT pid, rollout_idx, {s6('flip_cov', 'avg(CASE WHEN c <> x_t THEN 1.0 ELSE 0.0 END)')},
        {s6('flip_path', 'avg(CASE WHEN p <> x_t THEN 1.0 ELSE 0.0 END)')} FROM ds GROUP BY pid, rollout_idx""",
    ),
)
def g21(spark, sf):
    """Share of positions where steering every token changes the choice."""
    z = (F.col("z_s"), F.col("z_a"))

    def flips(tau: str) -> Column:
        return (A.argmax(mx.steer(F.lit(tau), *z, ALPHA, I.TEMPERATURE)) != F.col("x_t")).cast("double")

    rows = I.logit_pairs(spark, sf).select(*TRACE, flips("cov").alias("c"), flips("path").alias("p"))
    return rows.groupBy(*TRACE).agg(r6("flip_cov", F.avg("c")), r6("flip_path", F.avg("p")))


_KEY_SQL = "'7_' || pid || '_' || rollout_idx"


@query(
    "g22_random_position_steer",
    I.with_sql(
        *AT_T,
        f"""dr AS (SELECT pid, rollout_idx, 20 + {hash_sql(_KEY_SQL + " || '_t'")} % 30 AS t,
        CASE WHEN {hash_sql(_KEY_SQL + " || '_tau'")} % 2 = 0 THEN 'path' ELSE 'cov' END AS tau FROM xt GROUP BY pid, rollout_idx)""",
        f"""SELECT gt.pid, gt.rollout_idx, gt.t, any_value(tau) AS tau, (array_agg(token ORDER BY {_STEER} DESC, token))[1] AS steered
        FROM gt JOIN dr ON dr.pid = gt.pid AND dr.rollout_idx = gt.rollout_idx AND dr.t = gt.t GROUP BY gt.pid, gt.rollout_idx, gt.t""",
    ),
)
def g22(spark, sf):
    """Steering at one drawn position (20 to 49) with a drawn direction per trace."""
    key = (F.lit(7), F.col("pid"), F.col("rollout_idx"))
    drawn = I.logit_pairs(spark, sf).where(
        F.col("t") == draw_between(F.lit(20), F.lit(49), *key, F.lit("t"))
    ).withColumn("tau", draw_direction(*key, F.lit("tau")))
    return drawn.select(*KEY, "tau", A.argmax(mx.steer(F.col("tau"), F.col("z_s"), F.col("z_a"), ALPHA, I.TEMPERATURE)).alias("steered"))
