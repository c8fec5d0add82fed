"""Repair-sweep bookkeeping: request plans out, outcome tables in. Decoding itself is external."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefork.functions.draws import draw_between, draw_direction
from tracefork.operators.background import WARMUP

# Fixed values of the sweep.
BASE_CONDITIONS = ["retry", "rand", "geo_pred", "geo_wrong"]
LOCAL_TEMPERATURES = [1.0, 1.5, 2.0]
ABLATION_OFFSETS = [-10, -5, 0, 5, 10]
STEERING = ["rand", "geo_pred", "geo_wrong", "dense"]
SPARSE = ["geo_pred", "geo_wrong", "rand"]
BACKGROUND_SCALARS = ["mu_path", "sig_path", "mu_cov", "sig_cov", "mu_logV", "sig_logV", "lambda_J", "lambda_V"]

# The class names records carry, in their order.
RESCUER_CLASSES = {
    "retry": "retry",
    "sparse": "sparse steer",
    "dense": "dense steer",
    "local_temp": "local temperature lift",
}

CASE = ["pid", "k"]
NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def temperature_tag(value: float) -> str:
    return f"local_temp_{value}".replace(".", "p")


def local_temp_conditions(operators: Sequence[str]) -> list[tuple[str, float]]:
    if "local_temp" not in operators:
        return []
    return [(temperature_tag(v), v) for v in LOCAL_TEMPERATURES]


def request_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def random_draw(seed: int, warmup: int = WARMUP, max_new_tokens: int = 1024) -> dict[str, Column]:
    """The random arm's step and direction, reproducible per (seed, pid, k)."""
    high = max(warmup + 1, max_new_tokens // 2)
    key = (F.lit(seed), F.col("pid"), F.col("k"))
    return {
        "rand_t": draw_between(F.lit(warmup), F.lit(high), *key, F.lit("t")),
        "rand_tau": draw_direction(*key, F.lit("tau")),
    }


def request_plan(
    eligible: DataFrame,
    operators: Sequence[str] = ("geo", "rand", "dense", "local_temp"),
    seed: int = 42,
    warmup: int = WARMUP,
    max_new_tokens: int = 1024,
) -> DataFrame:
    """One row per (pid, k, condition) to decode. The four base conditions always run."""
    arms = [(c, None) for c in BASE_CONDITIONS] + local_temp_conditions(operators)
    rows = F.array(
        *[F.struct(F.lit(c).alias("condition"), F.lit(t).cast("double").alias("T_local")) for c, t in arms]
    )
    draws = random_draw(seed, warmup, max_new_tokens)
    is_rand = F.col("condition") == "rand"
    return (
        eligible.select(*CASE, F.explode(rows).alias("arm"))
        .select(*CASE, "arm.condition", "arm.T_local")
        .withColumn("req_key", request_key(F.col("pid"), F.col("k"), F.col("condition")))
        .withColumns({n: F.when(is_rand, c) for n, c in draws.items()})
    )


def read_back_fires(attempts: DataFrame, fires: DataFrame) -> DataFrame:
    """Outcomes = attempts with their fire event; no event means not fired and null details."""
    details = [c for c in fires.columns if c != "req_key"]
    fired = fires.select("req_key", F.lit(True).alias("_fired"), *details)
    return (
        attempts.join(fired, "req_key", "left")
        .withColumn("fired", F.coalesce("_fired", F.lit(False)))
        .drop("_fired")
    )


def _of(condition: str, value: str) -> Column:
    return F.max(F.when(F.col("condition") == condition, F.col(value)))


#: Flags that one whole number holds, of two bits each: seen, and seen true.
FLAGS_A_WORD = 31


def _folded(outcomes: DataFrame, conditions: Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """One narrow row per (pid, k), and the columns ``<condition>_<field>`` in terms of it.

    Flags, directions among them, travel as bits of a few numbers that hold all conditions; the aggregate keeps to
    fixed-width buffers and hashes.
    """
    coded = outcomes
    if "tau_hat" in fields:
        coded = coded.withColumn("tau_hat", F.col("tau_hat") == "path")
    types = {f.name: f.dataType.typeName() for f in coded.schema}
    n = len(conditions)
    flags = [f for f in fields if types[f] == "boolean"] if n <= FLAGS_A_WORD else []
    a_word = max(1, FLAGS_A_WORD // max(1, n))
    at = F.lit(None).cast("int")
    for i, c in enumerate(conditions):
        at = F.when(F.col("condition") == c, 2 * i).otherwise(at)
    words, values = {}, {}
    for w in range(0, len(flags), a_word):
        bits = F.lit(0).cast("bigint")
        for j, f in enumerate(flags[w : w + a_word]):
            shift = 2 * n * j
            seen = F.when(F.col(f), F.lit(3 << shift)).when(~F.col(f), F.lit(1 << shift)).otherwise(0).cast("bigint")
            bits = bits.bitwiseOR(seen)
            for i, c in enumerate(conditions):
                no, yes = ("cov", "path") if f == "tau_hat" else (False, True)
                state = F.shiftright(f"_bits_{w}", shift + 2 * i).bitwiseAND(F.lit(3).cast("bigint")).cast("int")
                values[f"{c}_{f}"] = F.get(F.array(F.lit(None), F.lit(no), F.lit(None), F.lit(yes)), state)
        words[f"_bits_{w}"] = F.call_function("shiftleft", bits, at)
    rest = [f for f in fields if f not in flags]
    folded = (
        coded.select(*CASE, "condition", *rest, *[b.alias(w) for w, b in words.items()])
        .groupBy(*CASE)
        .agg(*[F.bit_or(w).alias(w) for w in words], *[_of(c, f).alias(f"{c}_{f}") for c in conditions for f in rest])
    )
    for c, f in ((c, f) for c in conditions for f in rest):
        kept = F.col(f"{c}_{f}")
        values[f"{c}_{f}"] = F.when(kept, "path").when(~kept, "cov") if f == "tau_hat" else kept
    return folded, {f"{c}_{f}": values[f"{c}_{f}"] for c in conditions for f in fields}


def fold_results(outcomes: DataFrame, conditions: Sequence[str], fields: Sequence[str] = ("correct", "fired", "t_hat", "tau_hat")) -> DataFrame:
    """One record per (pid, k): ``<condition>_<field>`` columns."""
    folded, columns = _folded(outcomes, conditions, fields)
    return folded.select(*CASE, *[c.alias(name) for name, c in columns.items()])


#: What the record of a case keeps of each attempt.
RECORD_FIELDS = ("correct", "n_tokens", "fired", "t_hat", "tau_hat", "entropy_sensitive", "T_local", "fire_score")


def full_records(
    outcomes: DataFrame, dense: DataFrame, ablation: DataFrame, background: DataFrame, operators: Sequence[str] = ("local_temp",),
    flat: bool = False,
) -> DataFrame:
    """One record per (pid, k): a struct for each condition, ``dense`` (null where the case did not fire), the map
    ``ablation`` from offset to correct (empty without a second pass) and the struct ``background``.

    ``outcomes`` has one row per attempt with the fields of the record, of which a missing one is null everywhere;
    attempts that did not fire have null details. ``fire_score`` may be a struct. Attempts meet in one aggregate on
    fixed-width values; what is per case is joined to its narrow rows on the same key, and the structs are made last. ``flat`` gives the fields of the
    conditions as columns ``<condition>_<field>`` instead, those of ``fire_score`` among them, and makes no structs of them.
    """
    names = [*BASE_CONDITIONS, *(c for c, _ in local_temp_conditions(operators))]
    score = next((f for f in outcomes.schema if f.name == "fire_score"), None)
    parts = [f.name for f in score.dataType] if score is not None and hasattr(score.dataType, "fieldNames") else []
    single = outcomes.select("*", *[F.col(f"fire_score.{p}").alias(f"_score_{p}") for p in parts])
    fields = [f for f in RECORD_FIELDS if f in outcomes.columns and not (f == "fire_score" and parts)]
    folded, found = _folded(single, names, [*fields, *(f"_score_{p}" for p in parts)])

    def entry(condition: str) -> list[Column]:
        present = found[f"{condition}_correct"].isNotNull()
        values = {f: found[f"{condition}_{f}"] for f in fields}
        scores = {p: found[f"{condition}__score_{p}"] for p in parts}
        fired = found.get(f"{condition}_fired", F.lit(None))
        if flat:
            scores = {p: F.when(fired, v) for p, v in scores.items()}
            return [F.when(present, v).alias(f"{condition}_{f}") for f, v in {**values, **scores}.items()]
        if parts:
            values["fire_score"] = F.when(fired, F.struct(*[v.alias(p) for p, v in scores.items()]))
        return [F.when(present, F.struct(*[v.alias(f) for f, v in values.items()])).alias(condition)]

    own = [c for c in dense.columns if c not in (*CASE, "condition")]
    passed = dense.select(*CASE, F.struct(*own).alias("dense"))
    tried = ablation.groupBy(*CASE).agg(F.map_from_entries(F.collect_list(F.struct("offset", "correct"))).alias("ablation"))
    scalars = [f.name for f in background.schema if f.name not in CASE and f.dataType.typeName() in NUMERIC]
    known = background.select(*CASE, F.struct(*scalars).alias("background"))
    none = F.create_map().cast("map<bigint,boolean>")
    # As a lambda: the wide projection then stays out of the join's generated method, which the JVM would not compile.
    whole = F.transform_values(F.coalesce("ablation", none), lambda _, correct: correct).alias("ablation")
    joined = folded.join(passed, CASE, "left").join(tried, CASE, "left").join(known, CASE, "left")
    return joined.select(*CASE, *[e for c in names for e in entry(c)], "dense", whole, "background")


def fold_results_map(outcomes: DataFrame) -> DataFrame:
    """One record per (pid, k) with a map from condition to its result struct."""
    entry = F.struct("condition", F.struct("correct", "n_tokens", "t_hat", "tau_hat", "fired"))
    return outcomes.groupBy(*CASE).agg(F.map_from_entries(F.collect_list(entry)).alias("results"))


def ablation_plan(outcomes: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """Forced positions around every fired prediction."""
    fired = outcomes.where((F.col("condition") == "geo_pred") & F.col("fired") & F.col("t_hat").isNotNull())
    return (
        fired.select(*CASE, "t_hat", "tau_hat", F.explode(F.array(*[F.lit(o) for o in ABLATION_OFFSETS])).alias("off"))
        .select(
            *CASE,
            F.col("off").cast("bigint").alias("offset"),
            F.greatest(F.lit(warmup), F.col("t_hat") + F.col("off")).cast("bigint").alias("t_force"),
            F.col("tau_hat").alias("tau_force"),
        )
        .withColumn("req_key", request_key(F.col("pid"), F.col("k"), F.lit("abl"), F.col("offset")))
    )


def ablation_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """offset -> correct per case; an empty map where nothing fired."""
    folded = results.groupBy(*CASE).agg(
        F.map_from_entries(F.collect_list(F.struct("offset", "correct"))).alias("ablation")
    )
    empty = F.create_map().cast("map<bigint,boolean>")
    return cases.select(*CASE).distinct().join(folded, CASE, "left").withColumn(
        "ablation", F.coalesce("ablation", empty)
    )


def dense_cases(outcomes: DataFrame) -> DataFrame:
    """Cases whose prediction fired with a direction."""
    return outcomes.where(
        (F.col("condition") == "geo_pred") & F.col("fired") & F.col("tau_hat").isNotNull()
    ).select(*CASE, "tau_hat")


def merge_dense(records: DataFrame, dense: DataFrame) -> DataFrame:
    extra = dense.select(
        *CASE,
        F.col("correct").alias("dense_correct"),
        F.col("tau_hat").alias("dense_tau_hat"),
        F.col("n_tokens").alias("dense_n_tokens"),
    )
    return records.join(extra, CASE, "left")


def rescued_any_k(outcomes: DataFrame) -> DataFrame:
    """Per (pid, condition): rescued at any k.

    The sweep's own conditions travel as bits of one number (seen, judged, rescued), so a problem moves as one row and
    is unfolded afterwards. Any other condition is a group of its own under its name.
    """
    own = [*BASE_CONDITIONS, *(c for c, _ in local_temp_conditions(["local_temp"])), "dense"]
    place = F.lit(3 * len(own))
    for i, name in enumerate(own):
        place = F.when(F.col("condition") == name, 3 * i).otherwise(place)
    verdict = F.when(F.col("correct"), 7).when(~F.col("correct"), 3).otherwise(1).cast("bigint")
    folded = outcomes.select(
        "pid", F.when(~F.col("condition").isin(own), F.col("condition")).alias("other"), F.call_function("shiftleft", verdict, place).alias("bits")
    )
    folded = folded.groupBy("pid", "other").agg(F.bit_or("bits").alias("bits"))

    def entry(i: int, name: Column) -> Column:
        has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit << 3 * i)) != 0
        rescued = F.when(has(4), True).when(has(2), False)
        return F.when(has(1), F.struct(name.alias("condition"), rescued.alias("rescued")))

    entries = [entry(i, F.lit(name)) for i, name in enumerate(own)] + [entry(len(own), F.col("other"))]
    return folded.select("pid", F.explode(F.array(*entries)).alias("e")).where(F.col("e").isNotNull()).select("pid", "e.*")


def rescue_flags(outcomes: DataFrame) -> DataFrame:
    """Per problem: did resampling, sparse, dense or local temperature rescue it at any k?"""

    def any_of(condition: Column) -> Column:
        return F.coalesce(F.bool_or(F.when(condition, F.col("correct"))), F.lit(False))

    cond = F.col("condition")
    return outcomes.groupBy("pid").agg(
        any_of(cond == "retry").alias("retry"),
        any_of(cond.isin(SPARSE)).alias("sparse"),
        any_of(cond == "dense").alias("dense"),
        any_of(cond.startswith("local_temp_")).alias("local_temp"),
    )


def rescue_flags_of_records(records: DataFrame, verdicts: Mapping[str, Column]) -> DataFrame:
    """``rescue_flags`` from one row per case with every condition's verdict beside the others: nothing is unfolded."""
    classes = {
        "retry": ["retry"],
        "sparse": list(SPARSE),
        "dense": ["dense"],
        "local_temp": [c for c in verdicts if c.startswith("local_temp_")],
    }

    def any_of(names: Sequence[str]) -> Column:
        hit = F.lit(False)
        for name in names:
            if name in verdicts:
                hit = hit | F.coalesce(verdicts[name], F.lit(False))
        return F.bool_or(hit)

    return records.groupBy("pid").agg(*[any_of(names).alias(c) for c, names in classes.items()])


def regimes(flags: DataFrame) -> DataFrame:
    steered = F.col("sparse") | F.col("dense") | F.col("local_temp")
    return flags.withColumn(
        "regime", F.when(F.col("retry"), "SAMPLING").when(steered, "STEERABLE").otherwise("HARD")
    )


def rescuer_classes(flags: DataFrame) -> DataFrame:
    """``rescuers``: the classes that rescued, in fixed order."""
    return flags.withColumn(
        "rescuers", F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in RESCUER_CLASSES.items()]))
    )


def recoverability(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "recoverability",
        F.when(F.array_contains("rescuers", "retry"), "retry-solvable").otherwise("hard"),
    )


def rescue_rates(attempts: DataFrame, keys: Sequence[str] = ("cell", "problem_id"), operators: Sequence[str] = ()) -> DataFrame:
    """Rescue rate per operator, one column each, from single attempts."""
    rate = F.col("correct").cast("double")
    return attempts.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("operator") == o, rate)).alias(o) for o in operators]
    )


def background_scalars(background: DataFrame) -> DataFrame:
    return background.select(*CASE, *BACKGROUND_SCALARS, "w")


def wide_panel(flags: DataFrame, profiles: DataFrame) -> DataFrame:
    """Outcomes beside feature profiles, for problems present in both."""
    return flags.join(profiles, "pid")
