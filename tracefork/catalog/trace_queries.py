"""Queries over cached traces: trace features, backgrounds, firing and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefork.catalog import inputs as I
from tracefork.catalog.registry import pick, pick_sql, query, r6, s6
from tracefork.catalog.token_queries import SCORED, background, background_sql, scored, scores
from tracefork.operators import background as bg
from tracefork.operators import token_features as tf
from tracefork.operators import trace_features as trf
from tracefork.schemas import TRACE
from tracefork.session import durable

PF = trf.PROFILE_FEATURES
PROFILE_COLS = [f"{f}_{s}" for f in PF for s in ("trace", "junc")]
W8 = 8

ROLLOUT = [
    *I.TRIMMED,
    "rp AS (SELECT tr.pid, tr.rollout_idx, any_value(j) AS j, "
    + ", ".join(
        f"avg({f}) AS {f}_trace, avg({f}) FILTER (abs(t - j) <= {W8}) AS {f}_junc" for f in PF
    )
    + " FROM tr JOIN jn USING (pid, rollout_idx) GROUP BY tr.pid, tr.rollout_idx)",
]


@query("d1_trailing_trim", I.with_sql(*I.TRIMMED, "SELECT pid, rollout_idx, count(*) AS kept FROM tr GROUP BY pid, rollout_idx"))
def d1(spark, sf):
    return trf.trim(I.feature_cache(spark, sf)).select(*TRACE, F.size("J_approx").cast("bigint").alias("kept"))


@query("d2_junction", I.with_sql(*I.TRIMMED, "SELECT pid, rollout_idx, j AS junction FROM jn"))
def d2(spark, sf):
    return trf.junction(trf.trim(I.feature_cache(spark, sf))).select(*TRACE, "junction")


@query(
    "d3_junction_window_means",
    I.with_sql(*ROLLOUT, f"SELECT {pick_sql(TRACE, [f'{f}_junc' for f in PF])} FROM rp"),
)
def d3(spark, sf):
    return pick(trf.rollout_profile(I.feature_cache(spark, sf)), TRACE, [f"{f}_junc" for f in PF])


@query("d4_trace_means", I.with_sql(*ROLLOUT, f"SELECT {pick_sql(TRACE, [f'{f}_trace' for f in PF])} FROM rp"))
def d4(spark, sf):
    return pick(trf.rollout_profile(I.feature_cache(spark, sf)), TRACE, [f"{f}_trace" for f in PF])


_MEANS = ", ".join(s6(c, f"avg({c})") for c in PROFILE_COLS)


@query("d5_problem_means", I.with_sql(*ROLLOUT, f"SELECT pid, {s6('J_approx_trace', 'avg(J_approx_trace)')}, {s6('kl_div_junc', 'avg(kl_div_junc)')} FROM rp GROUP BY pid"))
def d5(spark, sf):
    return pick(trf.problem_profile(I.feature_cache(spark, sf)), ["pid"], ["J_approx_trace", "kl_div_junc"])


@query("d10_problem_profile", I.with_sql(*ROLLOUT, f"SELECT pid, {_MEANS} FROM rp GROUP BY pid"))
def d10(spark, sf):
    return pick(trf.problem_profile(I.feature_cache(spark, sf)), ["pid"], PROFILE_COLS)


ROUTING = [
    *ROLLOUT,
    f"""rf AS (SELECT pid, rollout_idx, avg(CASE WHEN J_approx > 0 THEN 1.0 ELSE 0.0 END) AS spread,
        log10(greatest(max(J_approx) / greatest(avg(J_approx), 1e-8), 1e-8)) AS concentration,
        log10(greatest(avg(logit_var) FILTER (abs(t - j) <= {W8}), 1e-8)) AS logit_dispersion
        FROM tr JOIN jn USING (pid, rollout_idx) GROUP BY pid, rollout_idx)""",
]


def _routing(name, column):
    @query(name, I.with_sql(*ROUTING, f"SELECT {pick_sql(TRACE, [column])} FROM rf"))
    def run(spark, sf):
        return pick(trf.rollout_routing_features(I.feature_cache(spark, sf)), TRACE, [column])


_routing("d6_spread", "spread")
_routing("d7_concentration", "concentration")
_routing("d8_logit_dispersion", "logit_dispersion")
_RF = ["spread", "concentration", "logit_dispersion"]


@query("d9_routing_features", I.with_sql(*ROUTING, "SELECT pid, " + ", ".join(s6(c, f"avg({c})") for c in _RF) + " FROM rf GROUP BY pid"))
def d9(spark, sf):
    return pick(trf.routing_features(I.feature_cache(spark, sf)), ["pid"], _RF)


# ---- background ----

_MOMENTS = ["mu_path", "sig_path", "mu_cov", "sig_cov", "mu_logV", "sig_logV"]
_FIRST_K = """fk AS (SELECT fc.*, k FROM fc JOIN (SELECT pid, rollout_idx, k FROM
    (SELECT pid, rollout_idx, row_number() OVER (PARTITION BY pid ORDER BY rollout_idx) AS place FROM fc GROUP BY pid, rollout_idx)
    CROSS JOIN (VALUES (1), (2)) v(k) WHERE place <= k) USING (pid, rollout_idx))"""
_BY_K = [
    *I.CACHE,
    _FIRST_K,
    """ks AS (SELECT *, ln(greatest(V, 1e-8)) AS log_v,
        sum(J_approx) OVER (PARTITION BY pid, k, rollout_idx ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS S FROM fk)""",
    """km AS (SELECT pid, k, avg(Delta_path) AS mu_path, stddev_pop(Delta_path) + 1e-6 AS sig_path, avg(G_cov) AS mu_cov,
        stddev_pop(G_cov) + 1e-6 AS sig_cov, avg(log_v) AS mu_logV, stddev_pop(log_v) + 1e-6 AS sig_logV,
        quantile_cont(S, 0.99) AS lambda_J FROM ks GROUP BY pid, k)""",
    """kv AS (SELECT pid, k, quantile_cont((log_v - mu_logV) / sig_logV, 0.75) AS lambda_V FROM ks JOIN km USING (pid, k) GROUP BY pid, k)""",
]


def by_k(spark, sf):
    cache = durable(I.feature_cache(spark, sf))
    return bg.backgrounds_for(cache.select(*TRACE), cache, [1, 2], w=3)


@query("e1_pooled_moments", I.with_sql(*_BY_K, f"SELECT pid, CAST(k AS BIGINT) AS k, {pick_sql([], _MOMENTS)} FROM km"))
def e1(spark, sf):
    return pick(by_k(spark, sf), ["pid", "k"], _MOMENTS)


@query(
    "e2_scan_statistic",
    I.with_sql(
        *I.CACHE,
        f"""SELECT pid, rollout_idx, t, {s6('S', 'sum(J_approx) OVER (PARTITION BY pid, rollout_idx ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} FROM fc""",
    ),
)
def e2(spark, sf):
    scan = bg.scan_statistic(I.feature_cache(spark, sf), 3)
    return scan.select(*TRACE, F.posexplode("S").alias("t", "S")).select(*TRACE, F.col("t").cast("bigint").alias("t"), r6("S"))


@query("e3_lambda_j", I.with_sql(*_BY_K, f"SELECT pid, CAST(k AS BIGINT) AS k, {s6('lambda_J')} FROM km"))
def e3(spark, sf):
    return pick(by_k(spark, sf), ["pid", "k"], ["lambda_J"])


@query("e4_lambda_v", I.with_sql(*_BY_K, f"SELECT pid, CAST(k AS BIGINT) AS k, {s6('lambda_V')} FROM kv"))
def e4(spark, sf):
    return pick(by_k(spark, sf), ["pid", "k"], ["lambda_V"])


@query(
    "e5_background",
    I.with_sql(
        *_BY_K,
        f"""SELECT pid, CAST(k AS BIGINT) AS k, {pick_sql([], [*_MOMENTS, 'lambda_J', 'lambda_V'])}, CAST(3 AS BIGINT) AS w,
        CAST(0.99 AS DOUBLE) AS q_J, CAST(0.75 AS DOUBLE) AS q_V FROM km JOIN kv USING (pid, k)""",
    ),
)
def e5(spark, sf):
    return pick(bg.require_background(by_k(spark, sf)), ["pid", "k", "w", "q_J", "q_V"], [*_MOMENTS, "lambda_J", "lambda_V"])


def fire_sql(w: int, warmup: int = 20) -> list[str]:
    return [
        f"""fq AS (SELECT b_s.pid, b_s.rollout_idx, t, S, Delta_path, G_cov, m.*  EXCLUDE (pid) FROM b_s JOIN b m ON m.pid = b_s.pid
            WHERE t >= greatest({warmup}, {w - 1}) AND S > lambda_J)""",
        """fp AS (SELECT *, CASE WHEN greatest(0, (Delta_path - mu_path) / (sig_path + 1e-6)) >= greatest(0, (G_cov - mu_cov) / (sig_cov + 1e-6))
            THEN 'path' ELSE 'cov' END AS tau FROM fq QUALIFY row_number() OVER (PARTITION BY pid, rollout_idx ORDER BY t) = 1)""",
    ]


FIRED90 = [*background_sql("b", 3, 0.9), *fire_sql(3)]
FIRED99 = [*background_sql("b", 1, 0.99), *fire_sql(1)]


def fired(spark, sf, w: int, q: float):
    return bg.firing_position(I.feature_cache(spark, sf), background(spark, sf, w, q), w)


@query("e6_firing_position", I.with_sql(*FIRED90, f"SELECT pid, rollout_idx, t AS t_hat, {s6('S_hat', 'S')} FROM fp"))
def e6(spark, sf):
    return pick(fired(spark, sf, 3, 0.9), [*TRACE, "t_hat"], ["S_hat"])


@query("e6_firing_position_strict", I.with_sql(*FIRED99, f"SELECT pid, rollout_idx, t AS t_hat, {s6('S_hat', 'S')} FROM fp"))
def e6_strict(spark, sf):
    return pick(fired(spark, sf, 1, 0.99), [*TRACE, "t_hat"], ["S_hat"])


@query("e7_direction", I.with_sql(*FIRED90, "SELECT pid, rollout_idx, tau AS tau_hat FROM fp"))
def e7(spark, sf):
    return fired(spark, sf, 3, 0.9).select(*TRACE, "tau_hat")


@query("e10_wrong_direction", I.with_sql(*FIRED90, "SELECT pid, rollout_idx, CASE tau WHEN 'path' THEN 'cov' ELSE 'path' END AS tau_hat FROM fp"))
def e10(spark, sf):
    return fired(spark, sf, 3, 0.9).select(*TRACE, bg.wrong_direction(F.col("tau_hat")).alias("tau_hat"))


@query(
    "e8_default_background",
    I.with_sql(
        *I.SWEEP,
        *background_sql("b"),
        f"""SELECT pid, k, {s6('lambda_J', 'coalesce(lambda_J, 0)')}, {s6('sig_path', 'coalesce(sig_path, 1)')}, {s6('sig_cov', 'coalesce(sig_cov, 1)')}
        FROM (SELECT pid, k FROM ln0) LEFT JOIN b USING (pid)""",
    ),
)
def e8(spark, sf):
    cases = I.sweep_lines(spark, sf).select("pid", "k")
    return pick(bg.with_background(cases, background(spark, sf), ["pid"]), ["pid", "k"], ["lambda_J", "sig_path", "sig_cov"])


# ---- online replay ----


def replay_sql(w: int, warmup: int = 20) -> list[str]:
    return [
        *SCORED,
        f"""rs AS (SELECT *, sum(J_t) OVER (PARTITION BY pid, rollout_idx ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS S_t,
            max(t) OVER (PARTITION BY pid, rollout_idx) AS last_t FROM sk)""",
        f"""rf AS (SELECT * FROM rs WHERE t >= greatest({warmup}, {w - 1}) AND t < last_t AND S_t > lambda_J
            QUALIFY row_number() OVER (PARTITION BY pid, rollout_idx ORDER BY t) = 1)""",
    ]


@query(
    "e11_online_replay",
    I.with_sql(*replay_sql(2), f"SELECT pid, rollout_idx, t AS t_hat, tau_t AS tau_hat, entropy_sensitive, {s6('S_t')} FROM rf"),
)
def e11(spark, sf):
    replay = bg.online_replay(scored(spark, sf), w=2)
    return replay.select(*TRACE, "t_hat", "tau_hat", "entropy_sensitive", r6("S_t", F.col("fire_score.S_t")))


_FIRE_FIELDS = ["Z_path", "Z_cov", "J_t", "S_t", "t_frac", "pS_on_set", "pA_on_set"]


@query(
    "e9_fire_score",
    I.with_sql(
        *replay_sql(2),
        f"SELECT pid, rollout_idx, t, {s6('t_frac', 't / 64')}, {pick_sql([], [f for f in _FIRE_FIELDS if f != 't_frac'])} FROM rf",
    ),
)
def e9(spark, sf):
    replay = bg.online_replay(scored(spark, sf), w=2, max_new_tokens=64).select(*TRACE, "fire_score.*")
    return pick(replay, [*TRACE, "t"], _FIRE_FIELDS)
