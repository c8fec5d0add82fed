"""Routing and population report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefork.catalog import inputs as I
from tracefork.catalog.registry import pick, pick_sql, query, r6, s6
from tracefork.operators import reports as rp
from tracefork.operators import routing as rt
from tracefork.schemas import INTERVENTIONS, PROFILE
from tracefork.session import fresh_path
from tracefork.sources.profiles import load_profiles

FEATS = ["spread", "concentration", "logit_dispersion"]
ZS = [f"z_{f}" for f in FEATS]


def z_sql(source: str, by: str = "", feats: list[str] | None = None, keep: str = "*") -> str:
    """Windowed population z-scores over ``source``."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    cols = ", ".join(
        f"CASE WHEN stddev_pop({f}) {over} = 0 THEN 0 ELSE ({f} - avg({f}) {over}) / stddev_pop({f}) {over} END AS z_{f}"
        for f in feats or FEATS
    )
    return f"SELECT {keep}, {cols} FROM {source}"


PEAK = "greatest(z_spread, z_concentration, z_logit_dispersion)"


def op_sql(fallback: bool = True) -> str:
    hedge = f"WHEN {PEAK} <= 0 THEN 'sparse_steer_random' " if fallback else ""
    return (
        f"CASE {hedge}WHEN z_spread >= {PEAK} THEN 'dense_steer' WHEN z_concentration >= {PEAK} THEN 'sparse_steer' "
        "ELSE 'local_temp' END AS operator"
    )


STEERABLE_BY_CELL = [
    *I.PROFILES,
    f"zc AS ({z_sql('lb', 'cell').replace(' FROM lb', '')} FROM lb WHERE label = 'steerable')",
    f"rt AS (SELECT *, {op_sql()} FROM zc)",
    """rr AS (SELECT *, CASE operator WHEN 'dense_steer' THEN dense_steer WHEN 'sparse_steer' THEN sparse_steer
        WHEN 'local_temp' THEN local_temp ELSE sparse_steer_random END AS routed_rate FROM rt)""",
]
STEERABLE_ALL = [
    *I.PROFILES,
    f"zc AS ({z_sql('lb')} WHERE label = 'steerable')",
    f"rt AS (SELECT *, {op_sql()} FROM zc)",
    STEERABLE_BY_CELL[-1],
]
MEANS = (
    "SELECT {by} count(*) AS n_steerable, avg(routed_rate) AS routed, avg(retry) AS retry, "
    + ", ".join(f"avg({c}) AS {c}" for c in INTERVENTIONS)
    + " FROM rr {group}"
)
MEANS_BY_CELL = "ms AS (" + MEANS.format(by="cell,", group="GROUP BY cell") + ")"
FIXED_BY_CELL = (
    "fx AS ("
    + " UNION ALL ".join(
        f"SELECT cell, '{c}' AS operator, {c} AS rate, {i} AS pos FROM ms" for i, c in enumerate(INTERVENTIONS)
    )
    + ")"
)
BEST_BY_CELL = "bs AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rate DESC, pos) AS place FROM fx)"


@query("a14_profiles", I.with_sql(*I.PROFILES, f"SELECT {pick_sql(['cell', 'problem_id', 'n_failed_rollouts'], [*FEATS, *I.RATES])} FROM pf"))
def a14(spark, sf):
    """Profiles written as CSV and loaded back by name."""
    path = fresh_path(spark, "profiles")
    cell = F.col("cell")
    full = I.profiles(spark, sf).withColumns({"model": F.substring(cell, 1, 1), "task": F.substring(cell, 3, 20)})
    full.select(*PROFILE.names).write.option("header", True).csv(path)
    loaded = load_profiles(spark, path).withColumn("n_failed_rollouts", F.col("n_failed_rollouts").cast("bigint"))
    return pick(loaded, ["cell", "problem_id", "n_failed_rollouts"], [*FEATS, *I.RATES])


@query("j1_zscore_by_cell", I.with_sql(*I.PROFILES, f"zc AS ({z_sql('pf', 'cell')})", f"SELECT {pick_sql(['cell', 'problem_id'], ZS)} FROM zc"))
def j1(spark, sf):
    return pick(rt.zscore(I.profiles(spark, sf), FEATS, ["cell"]), ["cell", "problem_id"], ZS)


@query("j2_route", I.with_sql(*I.PROFILES, f"zc AS ({z_sql('pf')})", f"SELECT cell, problem_id, {op_sql(False)} FROM zc"))
def j2(spark, sf):
    return rt.route(I.profiles(spark, sf), rt.ARGMAX).select("cell", "problem_id", "operator")


@query("j3_route_fallback", I.with_sql(*I.PROFILES, f"zc AS ({z_sql('pf', 'cell')})", f"SELECT cell, problem_id, {op_sql()} FROM zc"))
def j3(spark, sf):
    return rt.route(I.profiles(spark, sf), by=["cell"]).select("cell", "problem_id", "operator")


@query(
    "j4_custom_policy",
    I.with_sql(
        *I.PROFILES,
        f"zc AS ({z_sql('pf', '', ['concentration', 'spread'])})",
        """SELECT cell, problem_id, CASE WHEN greatest(z_concentration, z_spread) <= -0.25 THEN 'hold'
        WHEN z_concentration >= z_spread THEN 'pinpoint' ELSE 'broad' END AS operator FROM zc""",
    ),
)
def j4(spark, sf):
    policy = rt.Rules(("concentration", "pinpoint"), ("spread", "broad"), hedge=rt.Hedge("hold", -0.25))
    return rt.route(I.profiles(spark, sf), policy).select("cell", "problem_id", "operator")


@query("j5_route_scores", I.with_sql(*I.PROFILES, f"zc AS ({z_sql('pf')})", f"SELECT {pick_sql(['cell', 'problem_id'], ZS)} FROM zc"))
def j5(spark, sf):
    return pick(rt.route_scores(I.profiles(spark, sf)), ["cell", "problem_id"], ZS)


@query("j7_classify", I.with_sql(*I.PROFILES, "SELECT cell, problem_id, label FROM lb"))
def j7(spark, sf):
    return rp.classify(I.profiles(spark, sf)).select("cell", "problem_id", "label")


@query(
    "j8_taxonomy",
    I.with_sql(
        *I.PROFILES,
        "tx AS (SELECT cell, label, count(*) AS n FROM lb GROUP BY GROUPING SETS ((cell, label), (label)))",
        f"SELECT coalesce(cell, 'all cells') AS scope, label, n, {s6('share', 'n / sum(n) OVER (PARTITION BY cell)')} FROM tx",
    ),
)
def j8(spark, sf):
    tx = rp.taxonomy(I.profiles(spark, sf))
    return tx.select(F.coalesce("cell", F.lit("all cells")).alias("scope"), "label", "n", r6("share"))


@query("j9_cells", I.with_sql(*I.PROFILES, "SELECT cell, count(*) AS n FROM pf GROUP BY cell"))
def j9(spark, sf):
    return rp.list_cells(I.profiles(spark, sf))


@query("j9_selected_cell", I.with_sql(*I.PROFILES, "SELECT problem_id, label FROM lb WHERE cell = '1-URGENT'"))
def j9_one(spark, sf):
    return rp.classify(rp.select_cell(I.profiles(spark, sf), "1-URGENT")).select("problem_id", "label")


@query(
    "j10_steerable_routed",
    I.with_sql(*STEERABLE_BY_CELL, f"SELECT {pick_sql(['cell', 'problem_id', 'operator'], [*ZS, 'routed_rate'])} FROM rr"),
)
def j10(spark, sf):
    routed = rp.routed_steerable(I.profiles(spark, sf), ["cell"])
    return pick(routed, ["cell", "problem_id", "operator"], [*ZS, "routed_rate"])


_SIGNATURE = ", ".join(s6(f"mean_z_{f}", f"avg(z_{f})") for f in FEATS)
_PLACE = "list_position(['dense_steer', 'sparse_steer', 'local_temp', 'sparse_steer_random'], operator)"


@query(
    "j11_signature",
    I.with_sql(
        *STEERABLE_ALL,
        f"SELECT operator, count(*) AS n, CAST({_PLACE} AS BIGINT) AS place, {_SIGNATURE} FROM rr GROUP BY operator",
    ),
)
def j11(spark, sf):
    sig = rp.signature(rp.routed_steerable(I.profiles(spark, sf)))
    return pick(sig, ["operator", "n", "place"], [f"mean_z_{f}" for f in FEATS])


@query(
    "j12_routed_rate",
    I.with_sql(*STEERABLE_ALL, f"SELECT count(*) AS n_steerable, {s6('routed', 'avg(routed_rate)')}, {s6('retry', 'avg(retry)')} FROM rr"),
)
def j12(spark, sf):
    means = rp.routed_means(rp.routed_steerable(I.profiles(spark, sf)))
    return pick(means, ["n_steerable"], ["routed", "retry"])


@query(
    "j13_fixed_rates",
    I.with_sql(*STEERABLE_BY_CELL, MEANS_BY_CELL, FIXED_BY_CELL, BEST_BY_CELL, f"SELECT cell, operator, place, {s6('rate')} FROM bs"),
)
def j13(spark, sf):
    means = rp.routed_means(rp.routed_steerable(I.profiles(spark, sf), ["cell"]), ["cell"])
    return pick(rp.fixed_rates(means, ["cell"]), ["cell", "operator", "place"], ["rate"])


_VERDICT = f"""SELECT cell, n_steerable, {s6('routed')}, operator AS best_fixed, {s6('best_rate', 'rate')}, {s6('retry')},
    {s6('delta_pp', '100 * (routed - rate)')}, 100 * (routed - rate) >= 0 AS routing_wins
    FROM ms JOIN (SELECT cell, operator, rate FROM bs WHERE place = 1) USING (cell)"""


def verdicts(spark, sf):
    """Per cell: does routing each steerable failure beat the best single intervention?"""
    means = rp.routed_means(rp.routed_steerable(I.profiles(spark, sf), ["cell"]), ["cell"])
    report = rp.routing_report(means, ["cell"])
    return pick(
        report,
        ["cell", "n_steerable", "best_fixed", "routing_wins"],
        ["routed", "best_rate", "retry", "delta_pp"],
    )


query("j18_verdict_by_cell", I.with_sql(*STEERABLE_BY_CELL, MEANS_BY_CELL, FIXED_BY_CELL, BEST_BY_CELL, _VERDICT))(verdicts)


@query(
    "j14_verdict",
    I.with_sql(
        *STEERABLE_ALL,
        "ms AS (" + MEANS.format(by="'all' AS cell,", group="") + ")",
        FIXED_BY_CELL,
        BEST_BY_CELL,
        _VERDICT.replace("SELECT cell, n_steerable", "SELECT n_steerable", 1),
    ),
)
def j14(spark, sf):
    report = rp.routing_report(rp.routed_means(rp.routed_steerable(I.profiles(spark, sf))))
    return pick(report, ["n_steerable", "best_fixed", "routing_wins"], ["routed", "best_rate", "retry", "delta_pp"])


@query(
    "j15_panel_coordinates",
    I.with_sql(
        *STEERABLE_BY_CELL,
        f"SELECT cell, problem_id, operator, {s6('x', 'z_concentration - z_spread')}, {s6('y', 'z_logit_dispersion')} FROM rr",
    ),
)
def j15(spark, sf):
    panel = rp.panel_coordinates(rp.routed_steerable(I.profiles(spark, sf), ["cell"]))
    return pick(panel, ["cell", "problem_id", "operator"], ["x", "y"])


_PADDED = ", ".join(f"({f} - avg({f}) OVER ()) / (stddev_pop({f}) OVER () + 1e-8) AS z_{f}" for f in FEATS)


@query(
    "j16_route_padded",
    I.with_sql(*I.PROFILES, f"zc AS (SELECT *, {_PADDED} FROM pf)", f"SELECT problem_id, {op_sql(False)}, {pick_sql([], ZS)} FROM zc"),
)
def j16(spark, sf):
    records = I.profiles(spark, sf).select(
        F.col("problem_id").alias("pid"), F.array(*FEATS).alias("feats"), F.array().cast("array<string>").alias("rescuers")
    )
    return pick(rt.route_records(records).withColumnRenamed("pid", "problem_id"), ["problem_id", "operator"], ZS)


_PAIRS = [("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("a", "c"), ("b", "c")]
_COV = ", ".join(f"covar_samp({x}, {y}) AS {x}{y}" for x, y in _PAIRS)


@query(
    "j17_principal_variances",
    I.with_sql(
        *I.PROFILES,
        f"zp AS ({z_sql('pf')})",
        f"zn AS (SELECT {', '.join(f'{z} AS {n}' for z, n in zip(ZS, 'abc'))} FROM zp)",
        f"cv AS (SELECT {_COV} FROM zn)",
        # Eigenvalues of a symmetric 3 x 3 matrix in closed form.
        "q1 AS (SELECT *, (aa + bb + cc) / 3 AS q FROM cv)",
        "q2 AS (SELECT *, sqrt(((aa - q) ^ 2 + (bb - q) ^ 2 + (cc - q) ^ 2 + 2 * (ab ^ 2 + ac ^ 2 + bc ^ 2)) / 6) AS p FROM q1)",
        """q3 AS (SELECT *, acos(greatest(-1, least(1, ((aa - q) * ((bb - q) * (cc - q) - bc * bc) - ab * (ab * (cc - q) - bc * ac)
            + ac * (ab * bc - (bb - q) * ac)) / (2 * p ^ 3)))) / 3 AS phi FROM q2)""",
        "q4 AS (SELECT q, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM q3)",
        f"SELECT {s6('v1', 'e1')}, {s6('v2', '3 * q - e1 - e3')}, {s6('between', '0.0::DOUBLE')} FROM q4",
    ),
)
def j17_variances(spark, sf):
    """Variances along the two axes, whatever their signs, and that nothing varies together."""
    plane = rp.principal_plane(rt.zscore(I.profiles(spark, sf), FEATS), FEATS)
    found = plane.agg(F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2"), F.abs(F.covar_samp("pc1", "pc2")).alias("between"))
    return pick(found, [], ["v1", "v2", "between"])


@query("j17_principal_plane")
def j17(spark, sf):
    scored = rt.zscore(I.profiles(spark, sf), FEATS)
    return pick(rp.principal_plane(scored, FEATS), ["cell", "problem_id"], ["pc1", "pc2"])
