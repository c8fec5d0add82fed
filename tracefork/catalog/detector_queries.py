"""Queries over junction detectors and their calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefork.catalog import inputs as I
from tracefork.catalog.registry import pick, pick_sql, query, r6, s6
from tracefork.operators import detectors as dt
from tracefork.operators import page_hinkley as ph
from tracefork.schemas import TRACE

KEY = ["pid", "rollout_idx", "t"]

MIXED = [
    *I.LOGITS,
    """gp AS (SELECT zl.*, xt.x_t, exp(z_s) / sum(exp(z_s)) OVER (PARTITION BY zl.vec_id) AS p_s,
        exp(z_a) / sum(exp(z_a)) OVER (PARTITION BY zl.vec_id) AS p_a FROM zl JOIN xt USING (vec_id))""",
]
DEMOTION = [
    *MIXED,
    "dm AS (SELECT pid, rollout_idx, t, max(ln(p_s) - ln(p_a)) FILTER (token = x_t) AS d_t FROM gp GROUP BY pid, rollout_idx, t)",
]


@query(
    "f1_outcome_contrast",
    I.with_sql(
        *I.SIGNALS,
        """SELECT CAST(a.user_id AS VARCHAR) AS pair, min(a.t) AS step FROM sg a JOIN sg b
        ON b.user_id = a.user_id + 1 AND b.t = a.t WHERE a.user_id % 3 <> 0 AND b.user_id % 3 = 0 AND a.t >= 5
        AND a.token_id <> b.token_id GROUP BY a.user_id""",
    ),
)
def f1(spark, sf):
    """User u (failed) against user u + 1 (correct)."""
    steps = I.signal_traces(spark, sf)
    failed = steps.where(~F.col("is_correct")).withColumn("pair", F.col("pid"))
    good = steps.where("is_correct").withColumn("pair", (F.col("pid").cast("bigint") - 1).cast("string"))
    return dt.outcome_contrast(failed, good)


@query(
    "f2_ancestor_divergence",
    I.with_sql(
        *I.LOGITS,
        """tp AS (SELECT pid, rollout_idx, t, (array_agg(token ORDER BY z_s DESC, token))[1] AS top_s,
        (array_agg(token ORDER BY z_a DESC, token))[1] AS top_a FROM zl GROUP BY ALL)""",
        "SELECT *, top_s <> top_a AS fires FROM tp",
    ),
)
def f2(spark, sf):
    return dt.ancestor_divergence(I.logit_pairs(spark, sf)).select(*KEY, "top_s", "top_a", "fires")


@query(
    "f3_uncertainty_fork",
    I.with_sql(
        *MIXED,
        "un AS (SELECT pid, rollout_idx, t, -sum(p_s * ln(p_s + 1e-12)) AS u FROM gp GROUP BY pid, rollout_idx, t)",
        f"SELECT pid, rollout_idx, t, {s6('uncertainty', 'u')}, u > 2.0 AS fires FROM un",
    ),
)
def f3(spark, sf):
    return pick(dt.uncertainty_fork(I.logit_pairs(spark, sf)), [*KEY, "fires"], ["uncertainty"])


@query("f4_demotion_fixed", I.with_sql(*DEMOTION, f"SELECT pid, rollout_idx, t, {s6('d_t')} FROM dm WHERE d_t > 1.0 AND t >= 20"))
def f4(spark, sf):
    return pick(dt.demotion_fixed(dt.demotion_scores(I.logit_pairs(spark, sf))), KEY, ["d_t"])


def _top_share_sql(column: str) -> str:
    return f"""SELECT pid, rollout_idx, t, {s6(column)}, {s6('cut')} FROM
        (SELECT sg.*, cut FROM sg JOIN (SELECT pid, quantile_cont({column}, 0.9) AS cut FROM sg GROUP BY pid) USING (pid))
        WHERE {column} >= cut AND t >= 20"""


@query("f5_demotion_top_decile", I.with_sql(*I.SIGNALS, _top_share_sql("d_t")))
def f5(spark, sf):
    return pick(dt.top_share_flags(I.signal_traces(spark, sf), "d_t"), KEY, ["d_t", "cut"])


@query(
    "f6_top_junctions",
    I.with_sql(
        *I.SIGNALS,
        f"""SELECT pid, rollout_idx, t, place, {s6('score')} FROM (SELECT *, row_number() OVER (PARTITION BY pid
        ORDER BY score DESC NULLS LAST, t) AS place FROM (SELECT *, CASE WHEN t % 10 <> 3 THEN d_t END AS score FROM sg)) WHERE place <= 3""",
    ),
)
def f6(spark, sf):
    steps = I.signal_traces(spark, sf).withColumn("score", F.when(F.col("t") % 10 != 3, F.col("d_t")))
    return pick(dt.select_top(steps, "score", 3), [*KEY, "place"], ["score"])


GAPS = [
    *MIXED,
    "gr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z_a DESC, token) AS ra FROM gp)",
    """cg AS (SELECT pid, rollout_idx, t, sum(greatest(p_a - p_s, 0)) FILTER (ra <= 5) AS c_t FROM gr GROUP BY pid, rollout_idx, t)""",
]


@query("f9_coverage_gap", I.with_sql(*GAPS, f"SELECT {pick_sql(KEY, ['c_t'])} FROM cg"))
def f9(spark, sf):
    return pick(dt.coverage_gap(I.logit_pairs(spark, sf)), KEY, ["c_t"])


@query(
    "f7_coverage_fixed",
    I.with_sql(
        *GAPS,
        """cz AS (SELECT *, (c_t - avg(c_t) OVER (PARTITION BY pid, rollout_idx)) / stddev_pop(c_t) OVER (PARTITION BY pid, rollout_idx) AS coverage_z FROM cg)""",
        f"SELECT {pick_sql(KEY, ['coverage_z'])} FROM cz WHERE coverage_z > 1.0 AND t >= 20",
    ),
)
def f7(spark, sf):
    return pick(dt.coverage_fixed(dt.coverage_gap(I.logit_pairs(spark, sf))), KEY, ["coverage_z"])


@query(
    "f8_coverage_top_decile",
    I.with_sql(
        *GAPS,
        f"""SELECT pid, rollout_idx, t, {s6('c_t')} FROM cg JOIN (SELECT pid, rollout_idx, quantile_cont(c_t, 0.9) AS cut FROM cg
        GROUP BY pid, rollout_idx) USING (pid, rollout_idx) WHERE c_t >= cut AND t >= 20""",
    ),
)
def f8(spark, sf):
    return pick(dt.top_share_flags(dt.coverage_gap(I.logit_pairs(spark, sf)), "c_t"), KEY, ["c_t"])


LENGTHS = [*I.SIGNALS, "le AS (SELECT pid, rollout_idx, count(*) AS length FROM sg GROUP BY pid, rollout_idx)"]


def hash_sql(key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


@query(
    "f10_matched_position",
    I.with_sql(
        *LENGTHS,
        """rg AS (SELECT *, length // 2 AS ref_step, greatest(2, CAST(floor(0.1::DOUBLE * length) AS BIGINT)) // 2 AS half FROM le)""",
        "rh AS (SELECT *, greatest(0, ref_step - half) AS low, least(length - 1, ref_step + half) AS high FROM rg)",
        f"""SELECT pid, rollout_idx, ref_step, low, high,
        low + {hash_sql("'42_' || pid || '_' || rollout_idx || '_' || ref_step")} % (high - low + 1) AS step FROM rh""",
    ),
)
def f10(spark, sf):
    lengths = dt.trace_lengths(I.signal_traces(spark, sf))
    refs = lengths.withColumn("ref_step", F.floor(F.col("length") / 2).cast("bigint"))
    return dt.matched_position(refs).select(*TRACE, "ref_step", "low", "high", "step")


@query(
    "f11_random_position",
    I.with_sql(*LENGTHS, f"SELECT pid, rollout_idx, length, {hash_sql(chr(39) + '42_' + chr(39) + ' || pid || ' + chr(39) + '_' + chr(39) + ' || rollout_idx')} % greatest(length, 1) AS step FROM le"),
)
def f11(spark, sf):
    return dt.random_position(dt.trace_lengths(I.signal_traces(spark, sf)))


def fold_sql(signal: str, armed: int, lam: float) -> list[str]:
    """Page-Hinkley as a recursion over steps, frozen at the first crossing."""
    return [
        *I.SIGNALS,
        f"""fo AS (SELECT pid, t, {signal} AS x, {signal} AS mu, CAST(0 AS DOUBLE) AS g FROM sg WHERE t = 0
            UNION ALL
            SELECT s.pid, s.t, s.{signal}, 0.95::DOUBLE * f.mu + 0.05::DOUBLE * s.{signal},
            CASE WHEN s.t >= {armed} THEN greatest(0, f.g + (s.{signal} - (0.95::DOUBLE * f.mu + 0.05::DOUBLE * s.{signal}))) ELSE f.g END
            FROM fo f JOIN sg s ON s.pid = f.pid AND s.t = f.t + 1)""",
        f"""fh AS (SELECT * FROM fo WHERE t >= {armed} AND g > {lam} QUALIFY row_number() OVER (PARTITION BY pid ORDER BY t) = 1)""",
        "gm AS (SELECT pid, max(g) AS g_max FROM fo GROUP BY pid)",
    ]


def recursive(*parts: str) -> str:
    return I.with_sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


_FIRE = f"""SELECT pid, CAST(0 AS BIGINT) AS rollout_idx, t AS step, {s6('g_at_fire', 'g')}, {s6('mu_at_fire', 'mu')}, {s6('signal_at_fire', 'x')} FROM fh"""
_FIRE_COLS = ["g_at_fire", "mu_at_fire", "signal_at_fire"]


@query("f12_page_hinkley", recursive(*fold_sql("d_t", 20, 8.0), _FIRE))
def f12(spark, sf):
    return pick(ph.detect(I.signal_traces(spark, sf), lam=8.0), [*TRACE, "step"], _FIRE_COLS)


@query("f13_page_hinkley_coverage", recursive(*fold_sql("c_t", 20, 3.0), _FIRE))
def f13(spark, sf):
    return pick(ph.detect(I.signal_traces(spark, sf), lam=3.0, signal_type="coverage"), [*TRACE, "step"], _FIRE_COLS)


@query("f14_excess_maxima", recursive(*fold_sql("d_t", 20, 8.0), f"SELECT pid, CAST(0 AS BIGINT) AS rollout_idx, {s6('g_max')} FROM gm"))
def f14(spark, sf):
    return pick(ph.excess_maxima(I.signal_traces(spark, sf)), TRACE, ["g_max"])


def curves(spark, sf):
    return ph.exceedance_curves(ph.excess_maxima(I.signal_traces(spark, sf), carry=["is_correct"]))


_GRID = ", ".join(f"({v})" for v in ph.LAMBDA_GRID)


def curve_sql(name: str, correct: bool) -> str:
    test = "=" if correct else "<>"
    return f"""{name} AS (SELECT CAST(lam AS DOUBLE) AS lam, avg(CASE WHEN g_max > lam THEN 1.0 ELSE 0.0 END) AS {name}, count(*) AS n_{name}
        FROM gm CROSS JOIN (VALUES {_GRID}) v(lam) WHERE CAST(pid AS BIGINT) % 3 {test} 0 GROUP BY lam)"""


CURVES = [*fold_sql("d_t", 20, 8.0), curve_sql("far", True), curve_sql("tpr", False)]


@query("f15_false_alarm_curve", recursive(*CURVES, f"SELECT lam, n_far, {s6('far')} FROM far"))
def f15(spark, sf):
    return pick(curves(spark, sf), ["lam", "n_far"], ["far"])


@query("f16_detection_curve", recursive(*CURVES, f"SELECT lam, n_tpr, {s6('tpr')} FROM tpr"))
def f16(spark, sf):
    return pick(curves(spark, sf), ["lam", "n_tpr"], ["tpr"])


@query(
    "f17_joint_calibration",
    recursive(
        *CURVES,
        f"""SELECT lam AS chosen_lam, false AS lam_at_limit, {s6('youdens_j', 'tpr - far')}, n_far AS n_correct, n_tpr AS n_fail
        FROM far JOIN tpr USING (lam) WHERE far <= 0.25 ORDER BY tpr - far DESC, lam LIMIT 1""",
    ),
)
def f17(spark, sf):
    return pick(ph.calibrate_joint(curves(spark, sf), target=0.25), ["chosen_lam", "lam_at_limit", "n_correct", "n_fail"], ["youdens_j"])


@query(
    "f18_false_alarm_calibration",
    recursive(*CURVES, "SELECT min(lam) AS chosen_lam, false AS lam_at_limit, max(n_far) AS n_correct FROM far WHERE far <= 0.05"),
)
def f18(spark, sf):
    return ph.calibrate_far(curves(spark, sf))


@query("k2_detector_plugin", I.with_sql(*DEMOTION, "SELECT pid, rollout_idx, min(t) AS step FROM dm WHERE d_t > 1.5 AND t >= 20 GROUP BY pid, rollout_idx"))
def k2(spark, sf):
    """A user's own detector: a condition column handed to the plug-in surface."""
    mine = dt.ThresholdDetector(lambda: F.col("d_t") > 1.5, min_step=20)
    return mine.batch(dt.demotion_scores(I.logit_pairs(spark, sf)))
