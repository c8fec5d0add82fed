"""Queries over per-token features and full-vocabulary scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefork.catalog import inputs as I
from tracefork.catalog.registry import pick, pick_sql, query, r6, s6
from tracefork.operators import background as bg
from tracefork.operators import token_features as tf
from tracefork.schemas import TRACE
from tracefork.session import durable

KEY = ["pid", "rollout_idx", "t"]

# One query per feature: the same plan, pruned by Catalyst to what the column needs.
SINGLE = {
    "c1_truncated_lse": ["lse_s", "lse_a"],
    "c2_path_deformation": ["Delta_path"],
    "c3_taken_probability": ["V"],
    "c5_logit_variance": ["logit_var"],
    "c6_logit_skew": ["logit_skew"],
    "c7_logit_kurtosis": ["logit_kurt"],
    "c8_entropy": ["entropy"],
    "c9_kl_divergence": ["kl_div"],
    "c11_set_masses": ["pA_on_set", "pS_on_set"],
    "c12_coverage_deformation": ["G_cov"],
    "c13_demotion_pressure": ["J_approx"],
}


def _single(columns):
    return lambda spark, sf: pick(I.features(spark, sf), KEY, columns)


for _name, _columns in SINGLE.items():
    query(_name, I.with_sql(*I.FEATURES, f"SELECT {pick_sql(KEY, _columns)} FROM ft"))(_single(_columns))

ALL_FEATURES = ["Delta_path", "V", "logit_var", "logit_skew", "logit_kurt", "entropy", "kl_div", "pA_on_set", "G_cov", "J_approx"]


@query("c_token_features", I.with_sql(*I.FEATURES, f"SELECT {pick_sql([*KEY, 'pos', 'x_t'], ALL_FEATURES)} FROM ft"))
def c_all(spark, sf):
    return pick(I.features(spark, sf), [*KEY, "pos", "x_t"], ALL_FEATURES)


@query(
    "c4_renormalised_topk",
    I.with_sql(*I.FEATURES, f"SELECT pid, rollout_idx, pos, token, {s6('p')} FROM pn WHERE l_s IS NOT NULL"),
)
def c4(spark, sf):
    return pick(tf.renormalised(I.pairs_of_models(spark, sf)), ["pid", "rollout_idx", "pos", "token"], ["p"])


@query(
    "c10_coverage_set",
    I.with_sql(*I.TOPK, f"SELECT pid, rollout_idx, pos, token AS token_id FROM tk WHERE model = 'A' AND rank <= {I.K_COV}"),
)
def c10(spark, sf):
    return tf.coverage_set(I.topk(spark, sf), I.K_COV).select("pid", "rollout_idx", "pos", "token_id")


@query(
    "c10_features_without_ranks",
    I.with_sql(*I.FEATURES, f"SELECT {pick_sql(KEY, ['pA_on_set', 'pS_on_set', 'G_cov'])} FROM ft"),
)
def c10_fill(spark, sf):
    """A third of the positions lose their ranks; sorting by log-probability must give the same sets."""
    topk = I.topk(spark, sf).withColumn("rank", F.when(F.col("pos") % 3 != 0, F.col("rank")))
    out = tf.token_features(topk, I.taken(spark, sf), k_cov=I.K_COV)
    return pick(out, KEY, ["pA_on_set", "pS_on_set", "G_cov"])


@query(
    "c14_assembled_traces",
    I.with_sql(*I.CACHE, f"SELECT {pick_sql(KEY, ['Delta_path', 'J_approx', 'kl_div'])} FROM fc"),
)
def c14(spark, sf):
    names = ["Delta_path", "J_approx", "kl_div"]
    return pick(tf.explode_traces(I.feature_cache(spark, sf), names), KEY, names)


@query(
    "c14_trace_lengths",
    I.with_sql(*I.CACHE, f"SELECT pid, rollout_idx, count(*) AS length, {s6('peak', 'max(J_approx)')} FROM fc GROUP BY ALL"),
)
def c14_lengths(spark, sf):
    return I.feature_cache(spark, sf).select(
        *TRACE, F.size("J_approx").cast("bigint").alias("length"), r6("peak", F.array_max("J_approx"))
    )


T = I.T
FULL = [
    *I.LOGITS,
    f"""fv AS (SELECT zl.*, xt.x_t, z_s / {T} - ln(sum(exp(z_s / {T})) OVER (PARTITION BY zl.vec_id)) AS lp_s,
        z_a / {T} - ln(sum(exp(z_a / {T})) OVER (PARTITION BY zl.vec_id)) AS lp_a,
        row_number() OVER (PARTITION BY zl.vec_id ORDER BY z_s DESC, token) AS k_s,
        row_number() OVER (PARTITION BY zl.vec_id ORDER BY z_a DESC, token) AS k_a FROM zl JOIN xt USING (vec_id))""",
    f"""fw AS (SELECT *, CASE WHEN k_s <= {I.K_KL} THEN exp(lp_s) / (sum(exp(lp_s)) FILTER (k_s <= {I.K_KL}) OVER (PARTITION BY vec_id) + 1e-12) END AS p FROM fv)""",
    """fm AS (SELECT vec_id, sum(p * (lp_s - lp_a)) AS mu_r, sum(p * z_s) AS ez FROM fw GROUP BY vec_id)""",
    f"""sc AS (SELECT any_value(pid) AS pid, any_value(rollout_idx) AS rollout_idx, any_value(t) AS t,
        max(lp_s - lp_a) FILTER (token = x_t) AS r_chosen, any_value(mu_r) AS mu_r,
        sum(p * pow(lp_s - lp_a - mu_r, 2)) AS I_r, sum(p * pow(z_s - ez, 2)) AS V_t,
        sum(exp(lp_a)) FILTER (k_a <= {I.K_COV}) AS pA_on_set, sum(exp(lp_s)) FILTER (k_a <= {I.K_COV}) AS pS_on_set
        FROM fw JOIN fm USING (vec_id) GROUP BY vec_id)""",
    """ss AS (SELECT *, greatest(0, (r_chosen - mu_r) / (sqrt(I_r) + 1e-6)) AS Z_path,
        ln((pA_on_set + 1e-8) / (pS_on_set + 1e-8)) AS G_cov FROM sc)""",
]


def scores(spark, sf):
    return tf.full_vocab_scores(I.logit_pairs(spark, sf), I.TEMPERATURE, I.K_KL, I.K_COV)


def background_sql(name: str, w: int = 1, q: float = 0.99) -> list[str]:
    return [
        *I.CACHE,
        f"""{name}_s AS (SELECT *, ln(greatest(V, 1e-8)) AS log_v, sum(J_approx) OVER (PARTITION BY pid, rollout_idx ORDER BY t
            ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS S FROM fc)""",
        f"""{name}_m AS (SELECT pid, avg(Delta_path) AS mu_path, stddev_pop(Delta_path) + 1e-6 AS sig_path,
            avg(G_cov) AS mu_cov, stddev_pop(G_cov) + 1e-6 AS sig_cov, avg(log_v) AS mu_logV,
            stddev_pop(log_v) + 1e-6 AS sig_logV, quantile_cont(S, {q}) AS lambda_J FROM {name}_s GROUP BY pid)""",
        f"""{name} AS (SELECT m.*, v.lambda_V FROM {name}_m m JOIN (SELECT s.pid,
            quantile_cont((s.log_v - m.mu_logV) / m.sig_logV, 0.75) AS lambda_V
            FROM {name}_s s JOIN {name}_m m ON m.pid = s.pid GROUP BY s.pid) v ON v.pid = m.pid)""",
    ]


def background(spark, sf, w: int = 1, q: float = 0.99):
    """Background of each problem's first two rollouts (all it has), one row per problem."""
    cache = durable(I.feature_cache(spark, sf))
    return bg.backgrounds_for(cache.select(*TRACE), cache, [2], w, q).drop("k")


SCORED = [
    *FULL,
    *background_sql("bg"),
    """sj AS (SELECT ss.*, lambda_J, lambda_V, greatest(0, (G_cov - mu_cov) / (sig_cov + 1e-6)) AS Z_cov,
        (ln(greatest(V_t, 1e-8)) - mu_logV) / (sig_logV + 1e-6) AS Z_V FROM ss JOIN bg USING (pid))""",
    """sk AS (SELECT *, greatest(Z_path, Z_cov) AS J_t, CASE WHEN Z_path >= Z_cov THEN 'path' ELSE 'cov' END AS tau_t,
        Z_V > lambda_V AS entropy_sensitive FROM sj)""",
]


def scored(spark, sf):
    return tf.score_against(scores(spark, sf), background(spark, sf))


_C15 = ["Delta_path", "V", "pA_on_set", "pS_on_set", "G_cov", "J_approx"]


@query(
    "c15_full_vocabulary_features",
    I.with_sql(
        *FULL,
        f"""SELECT pid, rollout_idx, t, {s6('Delta_path', 'r_chosen')}, {s6('V', 'V_t')}, {s6('pA_on_set')}, {s6('pS_on_set')},
        {s6('G_cov')}, {s6('J_approx', 'greatest(r_chosen, 0) + greatest(G_cov, 0)')} FROM ss""",
    ),
)
def c15(spark, sf):
    named = scores(spark, sf).withColumnsRenamed({"r_chosen": "Delta_path", "V_t": "V"})
    return pick(named, KEY, _C15)


@query("c16_path_moments", I.with_sql(*FULL, f"SELECT {pick_sql(KEY, ['r_chosen', 'mu_r', 'I_r'])} FROM ss"))
def c16(spark, sf):
    return pick(scores(spark, sf), KEY, ["r_chosen", "mu_r", "I_r"])


@query("c17_path_z", I.with_sql(*FULL, f"SELECT {pick_sql(KEY, ['Z_path'])} FROM ss"))
def c17(spark, sf):
    return pick(scores(spark, sf), KEY, ["Z_path"])


@query("c18_coverage_z", I.with_sql(*SCORED, f"SELECT {pick_sql(KEY, ['Z_cov'])} FROM sk"))
def c18(spark, sf):
    return pick(scored(spark, sf), KEY, ["Z_cov"])


@query("c19_union_test", I.with_sql(*SCORED, f"SELECT {pick_sql([*KEY, 'tau_t'], ['J_t'])} FROM sk"))
def c19(spark, sf):
    return pick(scored(spark, sf), [*KEY, "tau_t"], ["J_t"])


@query("c20_temperature_susceptibility", I.with_sql(*SCORED, f"SELECT {pick_sql([*KEY, 'entropy_sensitive'], ['V_t', 'Z_V'])} FROM sk"))
def c20(spark, sf):
    return pick(scored(spark, sf), [*KEY, "entropy_sensitive"], ["V_t", "Z_V"])
