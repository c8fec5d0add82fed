"""The input tables of the registered queries, derived from the given tables: once as DataFrames, once as
SQL common table expressions for the oracle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefork.functions import arrays as A
from tracefork.operators import token_features as tf
from tracefork.plans.numbering import number_within
from tracefork.schemas import INTERVENTIONS, TRACE
from tracefork.session import durable

TEMPERATURE = tf.TEMPERATURE
TOP_K = 20
K_COV = 10
K_KL = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(*parts: str) -> str:
    """Join CTEs (each 'name AS (...)') and a final SELECT into one statement."""
    *ctes, final = parts
    seen = list(dict.fromkeys(c.strip() for c in ctes))
    return f"WITH {', '.join(seen)} {final}" if seen else final


# ---- logit pairs: one row per generated position ----


def logit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")
    )
    total = emb.agg(F.count("*")).scalar()
    other = emb.select(F.col("vec_id").alias("other_id"), F.col("e").alias("e2"))
    joined = emb.withColumn("other_id", (F.col("vec_id") + 7) % total).join(other, "other_id")
    z = joined.select(
        F.floor(F.col("vec_id") / 100).cast("string").alias("pid"),
        (F.floor(F.col("vec_id") / 50) % 2).cast("bigint").alias("rollout_idx"),
        (F.col("vec_id") % 50).alias("t"),
        "vec_id",
        F.transform("e", lambda x: F.lit(10.0) * x).alias("z_s"),
        F.zip_with("e", "e2", lambda a, b: F.lit(12.0) * (F.lit(0.6) * a + F.lit(0.4) * b)).alias("z_a"),
    )
    taken = F.when(F.col("vec_id") % 4 == 0, A.argmax(F.col("z_a"))).otherwise(A.argmax(F.col("z_s")))
    return z.withColumn("x_t", taken)


LOGITS = [
    "n AS (SELECT count(*) AS c FROM embeddings)",
    """zl AS (SELECT CAST(e.vec_id // 100 AS VARCHAR) AS pid, CAST((e.vec_id // 50) % 2 AS BIGINT) AS rollout_idx,
        e.vec_id % 50 AS t, e.vec_id, CAST(g.i AS BIGINT) AS token,
        CAST(10 AS DOUBLE) * CAST(e.embedding[g.i + 1] AS DOUBLE) AS z_s,
        CAST(12 AS DOUBLE) * (CAST(0.6 AS DOUBLE) * CAST(e.embedding[g.i + 1] AS DOUBLE)
            + CAST(0.4 AS DOUBLE) * CAST(f.embedding[g.i + 1] AS DOUBLE)) AS z_a
        FROM embeddings e CROSS JOIN n JOIN embeddings f ON f.vec_id = (e.vec_id + 7) % n.c
        CROSS JOIN range(64) g(i))""",
    """xt AS (SELECT vec_id, any_value(pid) AS pid, any_value(rollout_idx) AS rollout_idx, any_value(t) AS t,
        CASE WHEN vec_id % 4 = 0 THEN (array_agg(token ORDER BY z_a DESC, token))[1]
        ELSE (array_agg(token ORDER BY z_s DESC, token))[1] END AS x_t FROM zl GROUP BY vec_id)""",
]


def prompt_length(pid: Column) -> Column:
    return F.lit(3) + pid.cast("bigint") % 5


def topk(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    return topk_of(logit_pairs(spark, sf_dir), k)


def topk_of(pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k log-probabilities of both models by absolute position; the taken token is always present."""

    def entries(model: str, z: str) -> Column:
        ranked = A.top_entries(A.log_softmax(F.col(z)), None)
        return F.transform(
            ranked,
            lambda e, i: F.struct(
                F.lit(model).alias("model"),
                (-e["neg_index"]).cast("bigint").alias("token_id"),
                e["score"].alias("logprob"),
                (i + 1).cast("bigint").alias("rank"),
            ),
        )

    rows = pairs.select(
        *TRACE,
        (prompt_length(F.col("pid")) + F.col("t")).alias("pos"),
        "x_t",
        F.explode(F.concat(entries("S", "z_s"), entries("A", "z_a"))).alias("e"),
    )
    return rows.select(*TRACE, "pos", "x_t", "e.*").where((F.col("rank") <= k) | (F.col("token_id") == F.col("x_t"))).drop("x_t")


TOPK = [
    *LOGITS,
    """lp AS (SELECT zl.*, xt.x_t,
        z_s - ln(sum(exp(z_s)) OVER (PARTITION BY zl.vec_id)) AS l_s,
        z_a - ln(sum(exp(z_a)) OVER (PARTITION BY zl.vec_id)) AS l_a,
        row_number() OVER (PARTITION BY zl.vec_id ORDER BY z_s DESC, token) AS rank_s,
        row_number() OVER (PARTITION BY zl.vec_id ORDER BY z_a DESC, token) AS rank_a
        FROM zl JOIN xt USING (vec_id))""",
    f"""tk AS (SELECT pid, rollout_idx, t, 3 + CAST(pid AS BIGINT) % 5 + t AS pos, x_t, 'S' AS model, token, l_s AS logprob, rank_s AS rank
        FROM lp WHERE rank_s <= {TOP_K} OR token = x_t
        UNION ALL SELECT pid, rollout_idx, t, 3 + CAST(pid AS BIGINT) % 5 + t, x_t, 'A', token, l_a, rank_a
        FROM lp WHERE rank_a <= {TOP_K} OR token = x_t)""",
]


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output token ids per rollout with its prompt ids (traces of 50 tokens by construction)."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("t", "x_t"))), lambda e: e["x_t"])
    out = logit_pairs(spark, sf_dir).groupBy(*TRACE).agg(ids.alias("output_ids"))
    return out.select(
        *TRACE,
        "output_ids",
        prompt_length(F.col("pid")).alias("prompt_len"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt ids of every problem that occurs in the logit table."""
    pids = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("string").alias("pid")).distinct()
    return pids.select(
        "pid",
        F.transform(F.sequence(F.lit(1), prompt_length(F.col("pid"))), lambda i: F.col("pid").cast("bigint") * 7 + i).alias("prompt_ids"),
    )


def taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_of(logit_pairs(spark, sf_dir))


def taken_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(*TRACE, "t", (prompt_length(F.col("pid")) + F.col("t")).alias("pos"), "x_t")


def pairs_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = logit_pairs(spark, sf_dir)
    return tf.pair_models(topk_of(pairs), taken_of(pairs), ranks="trusted", k_cov=K_COV)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.features_of_pairs(pairs_of_models(spark, sf_dir), TEMPERATURE, K_COV)


T = f"CAST({TEMPERATURE} AS DOUBLE)"
FEATURES = [
    *TOPK,
    """pr AS (SELECT pid, rollout_idx, t, pos, token, any_value(x_t) AS x_t,
        max(logprob) FILTER (model = 'S') AS l_s, max(logprob) FILTER (model = 'A') AS l_a,
        max(rank) FILTER (model = 'A') AS rank_a FROM tk GROUP BY pid, rollout_idx, t, pos, token)""",
    f"""nrm AS (SELECT pid, rollout_idx, t, ln(sum(exp(l_s / {T})) + 1e-300) AS lse_s,
        ln(sum(exp(l_a / {T})) + 1e-300) AS lse_a FROM pr GROUP BY pid, rollout_idx, t)""",
    f"""pn AS (SELECT pr.*, lse_s, lse_a, exp(l_s / {T} - lse_s) / sum(exp(l_s / {T} - lse_s)) OVER (PARTITION BY pr.pid, pr.rollout_idx, pr.t) AS p
        FROM pr JOIN nrm USING (pid, rollout_idx, t))""",
    """mn AS (SELECT pid, rollout_idx, t, sum(p * l_s) AS m FROM pn GROUP BY pid, rollout_idx, t)""",
    f"""f0 AS (SELECT pid, rollout_idx, t, any_value(pos) AS pos, any_value(x_t) AS x_t, any_value(lse_s) AS lse_s, any_value(lse_a) AS lse_a,
        coalesce(max(l_s) FILTER (token = x_t), -1000) / {T} - any_value(lse_s) AS log_ps,
        coalesce(max(l_a) FILTER (token = x_t), -1000) / {T} - any_value(lse_a) AS log_pa,
        sum(p * pow(l_s - m, 2)) AS logit_var, sum(p * pow(l_s - m, 3)) AS logit_skew,
        sum(p * pow(l_s - m, 4)) - 3 * pow(sum(p * pow(l_s - m, 2)), 2) AS logit_kurt,
        -sum(p * ln(p + 1e-300)) AS entropy,
        greatest(sum(p * (ln(p + 1e-300) - (coalesce(l_a, -1000) / {T} - lse_a))), 0) AS kl_div,
        sum(exp(l_a / {T} - lse_a)) FILTER (rank_a <= {K_COV}) AS pA_on_set,
        sum(exp(coalesce(l_s, -1000) / {T} - lse_s)) FILTER (rank_a <= {K_COV}) AS pS_on_set
        FROM pn JOIN mn USING (pid, rollout_idx, t) GROUP BY pid, rollout_idx, t)""",
    """ft AS (SELECT *, log_ps - log_pa AS Delta_path, exp(log_ps) AS V, ln((pA_on_set + 1e-8) / (pS_on_set + 1e-8)) AS G_cov,
        greatest(log_ps - log_pa, 0) + greatest(ln((pA_on_set + 1e-8) / (pS_on_set + 1e-8)), 0) AS J_approx FROM f0)""",
]


def cached_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-token features with the trailing-trim cases: zero divergence at the tail, and all through one trace."""
    tail = (F.col("pid").cast("bigint") % 2 == 0) & (F.col("t") > 40)
    whole = (F.col("pid") == "1") & (F.col("rollout_idx") == 0)
    return features(spark, sf_dir).withColumn("kl_div", F.when(tail | whole, 0.0).otherwise(F.col("kl_div")))


def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf.assemble_traces(cached_features(spark, sf_dir))


CACHE = [
    *FEATURES,
    """fc AS (SELECT * REPLACE (CASE WHEN (CAST(pid AS BIGINT) % 2 = 0 AND t > 40) OR (pid = '1' AND rollout_idx = 0)
        THEN 0 ELSE kl_div END AS kl_div) FROM ft)""",
]
TRIMMED = [
    *CACHE,
    """last AS (SELECT pid, rollout_idx, coalesce(max(t) FILTER (kl_div <> 0), max(t)) AS last_t FROM fc GROUP BY pid, rollout_idx)""",
    """tr AS (SELECT fc.* FROM fc JOIN last USING (pid, rollout_idx) WHERE t <= last_t)""",
    """jn AS (SELECT pid, rollout_idx, (array_agg(t ORDER BY J_approx DESC, t))[1] AS j, count(*) AS len FROM tr GROUP BY pid, rollout_idx)""",
]

# ---- signal traces ----


def signal_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user event steps as detector signals."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    steps = number_within(events, ["user_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "t")
    signal = (F.col("value") - 30) / 30
    return steps.select(
        F.col("user_id").cast("string").alias("pid"),
        F.lit(0).cast("bigint").alias("rollout_idx"),
        "t",
        signal.alias("d_t"),
        F.when(F.col("event_type") == "error", signal).otherwise(0.0).alias("c_t"),
        (F.col("user_id") % 3 == 0).alias("is_correct"),
        (F.col("event_id") % 64).alias("token_id"),
    )


SIGNALS = [
    """sg AS (SELECT CAST(user_id AS VARCHAR) AS pid, CAST(0 AS BIGINT) AS rollout_idx,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
        (value - 30) / 30 AS d_t, CASE WHEN event_type = 'error' THEN (value - 30) / 30 ELSE 0 END AS c_t,
        user_id % 3 = 0 AS is_correct, event_id % 64 AS token_id, user_id FROM events)"""
]

# ---- failure profiles and sweep outcomes, from order lines ----

# The stand-in success rule of each operator on a line.
OPERATOR_RULES = {
    "retry": "(l_partkey * 7 + l_linenumber * 3) % 10 < 2",
    "sparse_steer": "(l_partkey * 3 + l_suppkey) % 10 < 3",
    "sparse_steer_random": "(l_suppkey * 7 + l_linenumber) % 10 < 2",
    "local_temp": "(l_partkey + l_suppkey * 3) % 10 < 2",
    "dense_steer": "(l_partkey * 9 + l_linenumber) % 10 < 3",
}
RATES = ["retry", *INTERVENTIONS]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (cell, problem). Lines are aggregated per order before the orders are joined.

    The narrow result is written once, as a profile table would be: routing reads it for its moments and for its rows.
    """
    lines = table(spark, sf_dir, "lineitem")
    per_order = lines.groupBy("l_orderkey").agg(
        F.count("*").alias("n_failed_rollouts"),
        *[F.avg(F.expr(OPERATOR_RULES[r]).cast("double")).alias(r) for r in RATES],
        F.avg((F.col("l_discount") > 0.05).cast("double")).alias("spread"),
        F.log10(F.max("l_extendedprice") / F.avg("l_extendedprice")).alias("concentration"),
        F.log10(F.greatest(F.var_pop("l_quantity"), F.lit(1e-8))).alias("logit_dispersion"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("cell"))
    joined = per_order.join(orders, per_order["l_orderkey"] == orders["o_orderkey"])
    return durable(
        joined.select(
            "cell",
            F.col("l_orderkey").cast("string").alias("problem_id"),
            "n_failed_rollouts",
            "spread",
            "concentration",
            "logit_dispersion",
            *RATES,
        )
    )


PROFILES = [
    "pf AS (SELECT o_orderpriority AS cell, CAST(l_orderkey AS VARCHAR) AS problem_id, count(*) AS n_failed_rollouts, "
    + ", ".join(f"avg(CASE WHEN {OPERATOR_RULES[r]} THEN 1.0 ELSE 0.0 END) AS {r}" for r in RATES)
    + """, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS spread,
        log10(max(l_extendedprice) / avg(l_extendedprice)) AS concentration,
        log10(greatest(var_pop(l_quantity), 1e-8)) AS logit_dispersion
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority, l_orderkey)""",
    """cl AS (SELECT *, greatest(sparse_steer, sparse_steer_random, local_temp, dense_steer) AS best FROM pf)""",
    """lb AS (SELECT *, CASE WHEN best - retry >= 0.05::DOUBLE AND 1.0::DOUBLE - retry >= 0.5::DOUBLE THEN 'steerable'
        WHEN best = 0 THEN 'beyond reach' ELSE 'resample' END AS label FROM cl)""",
]

# The stand-in success rule of each condition on a line.
CONDITION_RULES = {
    "retry": "(l_partkey * 7 + l_linenumber * 3) % 10 < 2",
    "rand": "(l_suppkey * 7 + l_linenumber) % 10 < 2",
    "geo_pred": "(l_partkey * 3 + l_suppkey) % 10 < 3",
    "geo_wrong": "(l_partkey * 3 + l_suppkey + 4) % 10 < 2",
    "local_temp_1p0": "(l_partkey + l_suppkey * 3) % 10 < 2",
    "local_temp_1p5": "(l_partkey + l_suppkey * 3 + 3) % 10 < 2",
    "local_temp_2p0": "(l_partkey + l_suppkey * 3 + 6) % 10 < 2",
    "dense": "(l_partkey * 9 + l_linenumber) % 10 < 3",
}
SWEPT = [c for c in CONDITION_RULES if c != "dense"]
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def sweep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as (pid, k) cases."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER)
    bucket = F.struct("l_linenumber", F.floor(F.col("l_partkey") / 256).alias("part"))
    return (
        number_within(lines, ["l_orderkey"], _LINE_ORDER, bucket, "k")
        .withColumn("pid", F.col("l_orderkey").cast("string"))
        .withColumn("k", F.col("k") + 1)
    )


# Cases that one task folds at most, on average: a few hundred bytes each, twice (before and after the merge).
CASES_A_TASK = 250_000


def dealt_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases numbered once, then dealt by (pid, k): what is folded or joined per case moves no further.

    The number of tasks grows with the cases, so that what a task holds does not.
    """
    lines = durable(sweep_lines(spark, sf_dir).select("pid", "k", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // CASES_A_TASK))
    return lines.repartition(tasks, "pid", "k")


def attempts(
    spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, conditions: Sequence[str] = tuple(SWEPT)
) -> DataFrame:
    """One row per (pid, k, swept condition) with its verdict; dense is a later pass."""
    arms = F.array(*[F.struct(F.lit(c).alias("condition"), F.expr(CONDITION_RULES[c]).alias("correct")) for c in conditions])
    return (
        (sweep_lines(spark, sf_dir) if lines is None else lines)
        .select("pid", "k", "l_partkey", "l_suppkey", "l_quantity", F.explode(arms).alias("a"))
        .select(
            "pid",
            "k",
            "a.condition",
            "a.correct",
            (F.col("l_partkey") % 97 + 1).alias("n_tokens"),
            F.concat_ws("_", "pid", F.col("k").cast("string"), "a.condition").alias("req_key"),
            "l_partkey",
            "l_suppkey",
            "l_quantity",
        )
    )


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fire log: steering and temperature conditions of lines that fired, keyed by request."""
    a = attempts(spark, sf_dir)
    return a.where((F.col("condition") != "retry") & (F.col("l_quantity") > 25)).select(
        "req_key",
        (F.col("l_partkey") % 200).alias("t_hat"),
        F.when(F.col("l_suppkey") % 2 == 0, "path").otherwise("cov").alias("tau_hat"),
    )


def outcomes(
    spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, conditions: Sequence[str] = tuple(SWEPT)
) -> DataFrame:
    """What the fire log joined to the attempts gives, worked out on the row."""
    fired = (F.col("condition") != "retry") & (F.col("l_quantity") > 25)
    return attempts(spark, sf_dir, lines, conditions).select(
        "pid",
        "k",
        "condition",
        "correct",
        "n_tokens",
        "req_key",
        fired.alias("fired"),
        F.when(fired, F.col("l_partkey") % 200).alias("t_hat"),
        F.when(fired, F.when(F.col("l_suppkey") % 2 == 0, "path").otherwise("cov")).alias("tau_hat"),
    )


def dense_outcomes(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The dense pass: only cases whose prediction fired."""
    lines = sweep_lines(spark, sf_dir) if lines is None else lines
    return lines.where(F.col("l_quantity") > 25).select(
        "pid",
        "k",
        F.lit("dense").alias("condition"),
        F.expr(CONDITION_RULES["dense"]).alias("correct"),
        (F.col("l_partkey") % 89 + 1).alias("n_tokens"),
        F.when(F.col("l_suppkey") % 2 == 0, "path").otherwise("cov").alias("tau_hat"),
    )


def all_outcomes(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Every (pid, k, condition, correct), dense included, one explode over the cases. Where only the problem counts,
    the cases need no number."""
    arms = [F.struct(F.lit(c).alias("condition"), F.expr(CONDITION_RULES[c]).alias("correct")) for c in SWEPT]
    dense = F.when(
        F.col("l_quantity") > 25,
        F.struct(F.lit("dense").alias("condition"), F.expr(CONDITION_RULES["dense"]).alias("correct")),
    )
    if numbered:
        cases, key = sweep_lines(spark, sf_dir), ["pid", "k"]
    else:
        cases, key = table(spark, sf_dir, "lineitem").withColumn("pid", F.col("l_orderkey").cast("string")), ["pid"]
    return (
        cases.select(*key, F.explode(F.array(*arms, dense)).alias("a"))
        .where(F.col("a").isNotNull())
        .select(*key, "a.condition", "a.correct")
    )


def case_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """The lines as cases, and the verdict of each condition on a line; dense is null where nothing fired."""
    rows = table(spark, sf_dir, "lineitem").withColumn("pid", F.col("l_orderkey").cast("string"))
    verdicts = {c: F.expr(CONDITION_RULES[c]) for c in SWEPT}
    verdicts["dense"] = F.when(F.col("l_quantity") > 25, F.expr(CONDITION_RULES["dense"]))
    return rows, verdicts


SWEEP = [
    """ln0 AS (SELECT CAST(l_orderkey AS VARCHAR) AS pid, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, * FROM lineitem)""",
    "att AS ("
    + " UNION ALL ".join(
        f"SELECT pid, k, '{c}' AS condition, {CONDITION_RULES[c]} AS correct, l_partkey % 97 + 1 AS n_tokens, "
        f"pid || '_' || k || '_{c}' AS req_key, l_partkey, l_suppkey, l_quantity FROM ln0"
        for c in SWEPT
    )
    + ")",
    """oc AS (SELECT pid, k, condition, correct, n_tokens, req_key, condition <> 'retry' AND l_quantity > 25 AS fired,
        CASE WHEN condition <> 'retry' AND l_quantity > 25 THEN l_partkey % 200 END AS t_hat,
        CASE WHEN condition <> 'retry' AND l_quantity > 25 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'path' ELSE 'cov' END END AS tau_hat
        FROM att)""",
    f"""dn AS (SELECT pid, k, 'dense' AS condition, {CONDITION_RULES['dense']} AS correct, l_partkey % 89 + 1 AS n_tokens,
        CASE WHEN l_suppkey % 2 = 0 THEN 'path' ELSE 'cov' END AS tau_hat FROM ln0 WHERE l_quantity > 25)""",
    """ao AS (SELECT pid, k, condition, correct FROM oc UNION ALL SELECT pid, k, condition, correct FROM dn)""",
]

# ---- problems and rollouts, from benchmark and documents ----



def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    digit = (item % 5).cast("string")
    return table(spark, sf_dir, "benchmark").select(
        item.cast("string").alias("problem_id"),
        F.col("text").alias("prompt"),
        F.when(item % 7 == 0, F.concat(F.lit("1,00"), digit)).otherwise(digit).alias("answer"),
    )


def repeated_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problems with line numbers; every third comes three times, and the answer of its last line differs."""
    item = F.col("problem_id").cast("bigint")
    one = problems(spark, sf_dir).withColumn("line", item * 10 + 5)
    early = one.where(item % 3 == 0).withColumns({"answer": F.lit("9999"), "line": item * 10})
    late = one.where(item % 3 == 0).withColumns({"answer": ((item + 1) % 5).cast("string"), "line": item * 10 + 7})
    return late.unionByName(one).unionByName(early)


def generated(text: Column, doc: Column, chars: Column) -> Column:
    digit = (chars % 5).cast("string")
    return (
        F.when(doc % 3 == 0, F.concat(text, F.lit(" \\boxed{"), digit, F.lit("}")))
        .when(doc % 3 == 1, F.concat(text, F.lit(" total 1,00"), digit, F.lit(" ")))
        .otherwise(text)
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rollouts of 40 problems (five of every forty-five have none); whole texts."""
    doc = F.col("doc_id")
    flags = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_correct"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return docs.join(flags, "doc_id", "left").select(
        (doc % 45).cast("string").alias("problem_id"),
        F.floor(doc / 45).cast("bigint").alias("rollout_idx"),
        generated(F.col("text"), doc, F.col("n_chars")).alias("generated_text"),
        "is_correct",
        "doc_id",
    )


PROBLEMS = [
    """pb AS (SELECT CAST(item_id AS VARCHAR) AS problem_id, text AS prompt,
        CASE WHEN item_id % 7 = 0 THEN '1,00' ELSE '' END || CAST(item_id % 5 AS VARCHAR) AS answer FROM benchmark)"""
]
ROLLOUTS = [
    *PROBLEMS,
    """ro AS (SELECT CAST(d.doc_id % 45 AS VARCHAR) AS problem_id, d.doc_id // 45 AS rollout_idx, d.doc_id,
        text || CASE WHEN d.doc_id % 3 = 0 THEN ' \\boxed{' || CAST(n_chars % 5 AS VARCHAR) || '}'
            WHEN d.doc_id % 3 = 1 THEN ' total 1,00' || CAST(n_chars % 5 AS VARCHAR) || ' ' ELSE '' END AS generated_text,
        l.quality = 1 AS is_correct FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
]


def _last_number_sql(text: str) -> str:
    found = f"regexp_extract_all({text}, '-?\\d[\\d,]*\\.?\\d*')"
    return f"replace({found}[-1], ',', '')"


def number_sql(text: str) -> str:
    boxes = f"regexp_extract_all({text}, '\\\\boxed\\{{([^}}]*)\\}}', 1)"
    return f"coalesce({_last_number_sql(boxes + '[-1]')}, {_last_number_sql(text)})"


def numeric_sql(text: str, gold: str) -> str:
    pred, want = number_sql(text), f"coalesce({number_sql(gold)}, trim({gold}))"
    return (
        f"coalesce(CASE WHEN TRY_CAST({pred} AS DOUBLE) IS NOT NULL AND TRY_CAST({want} AS DOUBLE) IS NOT NULL "
        f"THEN abs(TRY_CAST({pred} AS DOUBLE) - TRY_CAST({want} AS DOUBLE)) < 1e-6 ELSE {pred} = {want} END, false)"
    )


MARKED = [
    *ROLLOUTS,
    f"""mk AS (SELECT ro.*, pb.answer, coalesce(is_correct, {numeric_sql('generated_text', 'pb.answer')}) AS ok
        FROM ro LEFT JOIN pb USING (problem_id))""",
]
