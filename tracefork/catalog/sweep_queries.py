"""Queries over repair-sweep plans and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefork.catalog import inputs as I
from tracefork.catalog.detector_queries import hash_sql
from tracefork.catalog.registry import pick, query, r6, s6
from tracefork.catalog.token_queries import background, background_sql
from tracefork.catalog.trace_queries import ROUTING
from tracefork.operators import selection as sel
from tracefork.operators import sweep as sw
from tracefork.operators import trace_features as trf

K_VALUES = [1, 3, 5]
FAILED = [
    *I.MARKED,
    "fl AS (SELECT problem_id AS pid, rollout_idx FROM mk WHERE NOT ok)",
    "fr AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY rollout_idx) AS place FROM fl)",
    "cd AS (SELECT pid, rollout_idx FROM fl WHERE rollout_idx % 7 <> 5)",
    """el AS (SELECT pid, k FROM fr JOIN cd USING (pid, rollout_idx) CROSS JOIN (VALUES (1), (3), (5)) v(k)
        WHERE place <= k GROUP BY pid, k HAVING count(*) >= k)""",
]


def failed(spark, sf):
    from tracefork.functions.answers import numeric_answer

    return sel.failures(I.rollouts(spark, sf), I.problems(spark, sf), numeric_answer).withColumnRenamed("problem_id", "pid")


def cached(spark, sf):
    """The failures whose features are in the cache: all but every seventh index."""
    return failed(spark, sf).where(F.col("rollout_idx") % 7 != 5).select("pid", "rollout_idx")


def eligible(spark, sf):
    return sel.eligible_pairs(failed(spark, sf), cached(spark, sf), K_VALUES)


_DRAWS = f"""20 + {hash_sql("'42_' || pid || '_' || k || '_t'")} % 493 AS rand_t,
    CASE WHEN {hash_sql("'42_' || pid || '_' || k || '_tau'")} % 2 = 0 THEN 'path' ELSE 'cov' END AS rand_tau"""


@query(
    "h1_request_plan",
    I.with_sql(
        *FAILED,
        f"dr AS (SELECT pid, k, {_DRAWS} FROM el)",
        """SELECT pid, CAST(k AS BIGINT) AS k, condition, pid || '_' || k || '_' || condition AS req_key,
        CASE WHEN condition = 'rand' THEN rand_t END AS rand_t, CASE WHEN condition = 'rand' THEN rand_tau END AS rand_tau
        FROM dr CROSS JOIN (VALUES ('retry'), ('rand'), ('geo_pred'), ('geo_wrong'), ('local_temp_1p0'), ('local_temp_1p5'), ('local_temp_2p0')) v(condition)""",
    ),
)
def h1(spark, sf):
    return sw.request_plan(eligible(spark, sf)).drop("T_local")


@query(
    "h2_local_temperature_arms",
    I.with_sql(
        *FAILED,
        """SELECT pid, CAST(k AS BIGINT) AS k, 'local_temp_' || replace(CAST(v.T AS VARCHAR), '.', 'p') AS condition, CAST(v.T AS DOUBLE) AS T_local
        FROM el CROSS JOIN (VALUES (1.0), (1.5), (2.0)) v(T)""",
    ),
)
def h2(spark, sf):
    plan = sw.request_plan(eligible(spark, sf))
    return plan.where(F.col("T_local").isNotNull()).select("pid", "k", "condition", "T_local")


@query("h3_random_draw", I.with_sql(*I.SWEEP, f"SELECT pid, k, {_DRAWS} FROM ln0"))
def h3(spark, sf):
    return I.sweep_lines(spark, sf).select("pid", "k").withColumns(sw.random_draw(seed=42))


_FIELDS = ("correct", "fired", "t_hat", "tau_hat")
_FOLD = ", ".join(
    f"max({f}) FILTER (condition = '{c}') AS {c}_{f}" for c in ("retry", "rand", "geo_pred", "geo_wrong") for f in _FIELDS
)


@query("h4_folded_records", I.with_sql(*I.SWEEP, f"SELECT pid, k, {_FOLD} FROM oc GROUP BY pid, k"))
def h4(spark, sf):
    return sw.fold_results(I.outcomes(spark, sf), sw.BASE_CONDITIONS, _FIELDS)


_ALL = ["retry", "rand", "geo_pred", "geo_wrong", "local_temp_1p0", "local_temp_1p5", "local_temp_2p0"]
_RECORD = ["correct", "n_tokens", "fired", "t_hat", "tau_hat", "entropy_sensitive", "T_local", "S_t", "J_t"]
_FULL = ", ".join(f"max({f}) FILTER (condition = '{c}') AS {c}_{f}" for c in _ALL for f in _RECORD)


@query(
    "h4_full_records",
    I.with_sql(
        *I.SWEEP,
        """o2 AS (SELECT oc.*, CASE WHEN fired THEN t_hat % 3 = 0 END AS entropy_sensitive,
        CASE WHEN starts_with(condition, 'local_temp_') THEN CAST(replace(substr(condition, 12), 'p', '.') AS DOUBLE) END AS T_local,
        CASE WHEN fired THEN t_hat / 8 END AS S_t, CASE WHEN fired THEN t_hat / 16 END AS J_t FROM oc)""",
        f"fr AS (SELECT pid, k, {_FULL} FROM o2 GROUP BY pid, k)",
        """ab AS (SELECT pid, k, count(*) AS n, count(*) FILTER ((t_hat + o) % 3 = 0) AS n_right FROM oc
        CROSS JOIN (VALUES (-10), (-5), (0), (5), (10)) v(o) WHERE condition = 'geo_pred' AND fired GROUP BY pid, k)""",
        """SELECT fr.*, dn.correct AS dense_correct, dn.n_tokens AS dense_n_tokens, dn.tau_hat AS dense_tau_hat,
        coalesce(ab.n, 0) AS ablations, coalesce(ab.n_right, 0) AS ablations_right,
        CASE WHEN fr.k <= 3 THEN l_quantity / 4 END AS lambda_J, CASE WHEN fr.k <= 3 THEN l_partkey % 5 END AS w
        FROM fr JOIN ln0 USING (pid, k) LEFT JOIN dn USING (pid, k) LEFT JOIN ab USING (pid, k)""",
    ),
)
def h4_full(spark, sf):
    """Every field of every condition, the dense pass, the ablation map and the background's scalars."""
    lines = I.dealt_cases(spark, sf)
    outcomes, predicted = I.outcomes(spark, sf, lines), I.outcomes(spark, sf, lines, ["geo_pred"])
    temperature = F.lit(None).cast("double")
    for name, value in sw.local_temp_conditions(["local_temp"]):
        temperature = F.when(F.col("condition") == name, value).otherwise(temperature)
    score = F.when(F.col("fired"), F.struct((F.col("t_hat") / 8).alias("S_t"), (F.col("t_hat") / 16).alias("J_t")))
    told = outcomes.withColumns(
        {"entropy_sensitive": F.when(F.col("fired"), F.col("t_hat") % 3 == 0), "T_local": temperature, "fire_score": score}
    )
    found = lines.where("k <= 3").select(
        "pid", "k", (F.col("l_quantity") / 4).alias("lambda_J"), (F.col("l_partkey") % 5).alias("w"), F.lit("x").alias("name")
    )
    position = F.col("t_hat") + F.col("offset")
    tried = sw.ablation_plan(predicted).join(predicted.select("pid", "k", "t_hat"), ["pid", "k"])
    tried = tried.select("pid", "k", "offset", (position % 3 == 0).alias("correct"))
    records = sw.full_records(told, I.dense_outcomes(spark, sf, lines), tried, found, flat=True)
    plain = [f"{c}_{f}" for c in _ALL for f in _RECORD if f not in ("S_t", "J_t")]
    scores = [f"{c}_{f}" for c in _ALL for f in ("S_t", "J_t")]
    return records.select(
        "pid", "k", *plain, *scores,
        *[F.col(f"dense.{f}").alias(f"dense_{f}") for f in ("correct", "n_tokens", "tau_hat")],
        F.size("ablation").cast("bigint").alias("ablations"),
        F.size(F.filter(F.map_values("ablation"), lambda v: v)).cast("bigint").alias("ablations_right"),
        "background.lambda_J", "background.w",
    )


@query(
    "h5_ablation_plan",
    I.with_sql(
        *I.SWEEP,
        """SELECT pid, k, CAST(o AS BIGINT) AS "offset", greatest(20, t_hat + o) AS t_force, tau_hat AS tau_force, pid || '_' || k || '_abl_' || o AS req_key
        FROM oc CROSS JOIN (VALUES (-10), (-5), (0), (5), (10)) v(o) WHERE condition = 'geo_pred' AND fired""",
    ),
)
def h5(spark, sf):
    return sw.ablation_plan(I.outcomes(spark, sf))


@query(
    "h6_ablation_results",
    I.with_sql(
        *I.SWEEP,
        """ab AS (SELECT pid, k, count(*) AS n, count(*) FILTER ((t_hat + o) % 3 = 0) AS n_correct,
        bool_or((t_hat + o) % 3 = 0) FILTER (o = 5) AS at_5 FROM oc CROSS JOIN (VALUES (-10), (-5), (0), (5), (10)) v(o)
        WHERE condition = 'geo_pred' AND fired GROUP BY pid, k)""",
        "SELECT pid, k, coalesce(n, 0) AS n, coalesce(n_correct, 0) AS n_correct, at_5 FROM ln0 LEFT JOIN ab USING (pid, k)",
    ),
)
def h6(spark, sf):
    """Ablated attempts are judged by their unclamped position."""
    outcomes = I.outcomes(spark, sf)
    position = F.col("t_hat") + F.col("offset")
    results = (
        sw.ablation_plan(outcomes)
        .join(outcomes.where("condition = 'geo_pred'").select("pid", "k", "t_hat"), ["pid", "k"])
        .select("pid", "k", "offset", (position % 3 == 0).alias("correct"))
    )
    maps = sw.ablation_results(I.sweep_lines(spark, sf), results)
    values = F.map_values("ablation")
    return maps.select(
        "pid",
        "k",
        F.size("ablation").cast("bigint").alias("n"),
        F.size(F.filter(values, lambda v: v)).cast("bigint").alias("n_correct"),
        F.try_element_at("ablation", F.lit(5).cast("bigint")).alias("at_5"),
    )


@query("h7_dense_cases", I.with_sql(*I.SWEEP, "SELECT pid, k, tau_hat FROM oc WHERE condition = 'geo_pred' AND fired"))
def h7(spark, sf):
    return sw.dense_cases(I.outcomes(spark, sf))


@query(
    "h8_dense_merge",
    I.with_sql(
        *I.SWEEP,
        """SELECT r.pid, r.k, r.correct AS retry_correct, dn.correct AS dense_correct, dn.tau_hat AS dense_tau_hat, dn.n_tokens AS dense_n_tokens
        FROM (SELECT * FROM oc WHERE condition = 'retry') r LEFT JOIN dn USING (pid, k)""",
    ),
)
def h8(spark, sf):
    records = sw.fold_results(I.outcomes(spark, sf), ["retry"], ("correct",))
    return sw.merge_dense(records, I.dense_outcomes(spark, sf))


@query("h9_rescued_any_k", I.with_sql(*I.SWEEP, "SELECT pid, condition, bool_or(correct) AS rescued FROM ao GROUP BY pid, condition"))
def h9(spark, sf):
    return sw.rescued_any_k(I.all_outcomes(spark, sf))


FLAGS = [
    *I.SWEEP,
    """fg AS (SELECT pid, bool_or(correct) FILTER (condition = 'retry') AS retry,
        bool_or(correct) FILTER (condition IN ('rand', 'geo_pred', 'geo_wrong')) AS sparse,
        coalesce(bool_or(correct) FILTER (condition = 'dense'), false) AS dense,
        bool_or(correct) FILTER (starts_with(condition, 'local_temp_')) AS local_temp FROM ao GROUP BY pid)""",
    "rg AS (SELECT *, CASE WHEN retry THEN 'SAMPLING' WHEN sparse OR dense OR local_temp THEN 'STEERABLE' ELSE 'HARD' END AS regime FROM fg)",
]


def flags(spark, sf):
    return sw.rescue_flags_of_records(*I.case_records(spark, sf))


@query("h10_regimes", I.with_sql(*FLAGS, "SELECT regime, count(*) AS n FROM rg GROUP BY regime"))
def h10(spark, sf):
    return sw.regimes(flags(spark, sf)).groupBy("regime").agg(F.count("*").alias("n"))


@query(
    "h11_rescuer_classes",
    I.with_sql(
        *FLAGS,
        """SELECT pid, concat_ws('|', CASE WHEN retry THEN 'retry' END, CASE WHEN sparse THEN 'sparse steer' END,
        CASE WHEN dense THEN 'dense steer' END, CASE WHEN local_temp THEN 'local temperature lift' END) AS rescuers FROM fg""",
    ),
)
def h11(spark, sf):
    return sw.rescuer_classes(flags(spark, sf)).select("pid", F.array_join("rescuers", "|").alias("rescuers"))


@query(
    "h12_recoverability",
    I.with_sql(*FLAGS, "SELECT CASE WHEN retry THEN 'retry-solvable' ELSE 'hard' END AS recoverability, count(*) AS n FROM fg GROUP BY ALL"),
)
def h12(spark, sf):
    """From single outcomes, one row per condition."""
    records = sw.rescuer_classes(sw.rescue_flags(I.all_outcomes(spark, sf, numbered=False)))
    return sw.recoverability(records).groupBy("recoverability").agg(F.count("*").alias("n"))


@query("h13_rescue_rates", I.with_sql(*I.PROFILES, f"SELECT cell, problem_id, {', '.join(s6(r) for r in I.RATES)} FROM pf"))
def h13(spark, sf):
    """Rates from single attempts: one row per (line, operator), averaged per problem, then its cell."""
    arms = F.array(*[F.struct(F.lit(o).alias("operator"), F.expr(rule).alias("correct")) for o, rule in I.OPERATOR_RULES.items()])
    attempts = I.table(spark, sf, "lineitem").select("l_orderkey", F.explode(arms).alias("a")).select("l_orderkey", "a.*")
    rates = sw.rescue_rates(attempts, ["l_orderkey"], I.RATES)
    cells = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("cell"))
    joined = rates.join(cells, "l_orderkey").withColumn("problem_id", F.col("l_orderkey").cast("string"))
    return pick(joined, ["cell", "problem_id"], I.RATES)


@query(
    "h14_background_scalars",
    I.with_sql(*background_sql("b"), f"SELECT pid, CAST(2 AS BIGINT) AS k, {', '.join(s6(c) for c in sw.BACKGROUND_SCALARS)}, CAST(1 AS BIGINT) AS w FROM b"),
)
def h14(spark, sf):
    scalars = sw.background_scalars(background(spark, sf).withColumn("k", F.lit(2).cast("bigint")))
    return pick(scalars, ["pid", "k", "w"], sw.BACKGROUND_SCALARS)


@query(
    "h15_wide_panel",
    I.with_sql(
        *ROUTING,
        *FLAGS,
        "rp2 AS (SELECT pid, avg(spread) AS spread, avg(concentration) AS concentration, avg(logit_dispersion) AS logit_dispersion FROM rf GROUP BY pid)",
        f"""SELECT pid, regime, {s6('spread')}, {s6('concentration')}, {s6('logit_dispersion')} FROM rg JOIN rp2 USING (pid)""",
    ),
)
def h15(spark, sf):
    panel = sw.wide_panel(sw.regimes(flags(spark, sf)), trf.routing_features(I.feature_cache(spark, sf)))
    return pick(panel, ["pid", "regime"], ["spread", "concentration", "logit_dispersion"])


def marked(spark, sf):
    from tracefork.functions.answers import numeric_answer

    return sel.mark_correct(I.rollouts(spark, sf), I.problems(spark, sf), numeric_answer)


@query("h16_failure_counts", I.with_sql(*I.MARKED, "SELECT problem_id, count(*) FILTER (NOT ok) AS n_failed, count(*) AS n_total FROM mk GROUP BY problem_id"))
def h16(spark, sf):
    return sel.failure_counts(marked(spark, sf), ["problem_id"])


@query("h16_failure_totals", I.with_sql(*I.MARKED, "SELECT count(*) FILTER (NOT ok) AS n_failed, count(*) AS n_total FROM mk"))
def h16_all(spark, sf):
    return sel.failure_counts(marked(spark, sf))


@query("a17_fire_read_back", I.with_sql(*I.SWEEP, "SELECT req_key, correct, fired, t_hat, tau_hat FROM oc"))
def a17(spark, sf):
    attempts = I.attempts(spark, sf).select("req_key", "correct")
    return sw.read_back_fires(attempts, I.fires(spark, sf)).select("req_key", "correct", "fired", "t_hat", "tau_hat")


@query("b14_eligible_pairs", I.with_sql(*FAILED, "SELECT pid, CAST(k AS BIGINT) AS k FROM el"))
def b14(spark, sf):
    return eligible(spark, sf)


@query("b13_first_failures", I.with_sql(*FAILED, "SELECT pid, rollout_idx, place FROM fr WHERE place <= 3"))
def b13(spark, sf):
    return sel.first_failures(failed(spark, sf), 3).select("pid", "rollout_idx", "place")
