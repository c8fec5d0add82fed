"""Trace features, backgrounds and firing against direct evaluation; the cache round trip."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefork.operators import background as bg
from tracefork.operators import sweep as sw
from tracefork.operators import trace_features as trf
from tracefork.schemas import CACHE_ARRAYS
from tracefork.sources import feature_cache as fc

ARRAYS = ", ".join(f"{n} array<double>" for n in CACHE_ARRAYS)


def payloads(n=7, seed=0, low=20, high=60):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        size = rng.randrange(low, high)
        d = {f: [rng.gauss(0.4, 1.0) for _ in range(size)] for f in CACHE_ARRAYS}
        d["kl_div"] = [0.0] * (size // 5) + [rng.random() for _ in range(size - size // 5)]
        d["V"] = [rng.random() for _ in range(size)]
        d["J_approx"] = [max(0.0, a) + max(0.0, b) for a, b in zip(d["Delta_path"], d["G_cov"])]
        out[(f"sample_{i % 4}", i // 4)] = d
    return out


def frame(spark, data):
    rows = [(pid, idx, *[d[f] for f in CACHE_ARRAYS]) for (pid, idx), d in data.items()]
    return spark.createDataFrame(rows, f"pid string, rollout_idx long, {ARRAYS}")


def trimmed(d):
    nonzero = [t for t, v in enumerate(d["kl_div"]) if v != 0]
    end = nonzero[-1] + 1 if nonzero else len(d["kl_div"])
    return {f: np.array(v[:end]) for f, v in d.items()}


def test_rollout_profile(spark):
    data = payloads()
    data[("sample_0", 0)]["kl_div"][-4:] = [0.0] * 4
    data[("sample_1", 0)]["kl_div"] = [0.0] * len(data[("sample_1", 0)]["kl_div"])
    got = {(r.pid, r.rollout_idx): r for r in trf.rollout_profile(frame(spark, data), 5).collect()}
    for key, d in data.items():
        a = trimmed(d)
        j = int(np.argmax(a["J_approx"]))
        window = slice(max(0, j - 5), j + 6)
        assert got[key].junction == j
        for f in trf.PROFILE_FEATURES:
            assert got[key][f"{f}_trace"] == pytest.approx(a[f].mean())
            assert got[key][f"{f}_junc"] == pytest.approx(a[f][window].mean())


def test_first_of_tied_peaks_is_the_junction(spark):
    d = payloads(1)[("sample_0", 0)]
    d["J_approx"] = [0.0] * len(d["J_approx"])
    for t in (7, 12):
        d["J_approx"][t] = 3.0
    assert trf.rollout_profile(frame(spark, {("p", 0): d})).first().junction == 7


def test_flat_trace_has_the_lowest_concentration(spark):
    d = payloads(1)[("sample_0", 0)]
    d["J_approx"] = [0.0] * len(d["J_approx"])
    d["logit_var"] = [0.0] * len(d["J_approx"])
    row = trf.rollout_routing_features(frame(spark, {("p", 0): d})).first()
    assert (row.spread, row.concentration, row.logit_dispersion) == (0.0, -8.0, -8.0)


def test_problem_features_average_rollouts(spark):
    data = payloads(8)
    per_rollout = trf.rollout_routing_features(frame(spark, data)).toPandas()
    per_problem = trf.routing_features(frame(spark, data)).toPandas().set_index("pid")
    means = per_rollout.groupby("pid")[["spread", "concentration", "logit_dispersion"]].mean()
    assert np.allclose(per_problem.loc[means.index, means.columns], means)


def background_of(caches, w, q_j=0.99, q_v=0.75):
    path, cov = (np.concatenate([c[f] for c in caches]) for f in ("Delta_path", "G_cov"))
    logv = np.log(np.maximum(np.concatenate([c["V"] for c in caches]), 1e-8))
    scans = [sum(c["J_approx"][max(0, t - w + 1) : t + 1]) for c in caches for t in range(len(c["J_approx"]))]
    out = {}
    for name, x in (("path", path), ("cov", cov), ("logV", logv)):
        out[f"mu_{name}"], out[f"sig_{name}"] = x.mean(), x.std() + 1e-6
    out["lambda_J"] = np.quantile(scans, q_j)
    out["lambda_V"] = np.quantile((logv - out["mu_logV"]) / out["sig_logV"], q_v)
    return out


@pytest.mark.parametrize("w", [1, 4])
def test_backgrounds_of_first_k_failures(spark, w):
    data = payloads(8)
    cache = frame(spark, data)
    failed = cache.select("pid", "rollout_idx")
    cached = cache.where("NOT (pid = 'sample_3' AND rollout_idx = 0)")
    got = {(r.pid, r.k): r for r in bg.backgrounds_for(failed, cached, [1, 2, 5], w).collect()}
    # k = 5 exceeds what any problem has; sample_3 lacks its first failure, so it has no k at all
    assert set(got) == {(f"sample_{i}", k) for i in range(3) for k in (1, 2)}
    for (pid, k), r in got.items():
        want = background_of([data[(pid, i)] for i in range(k)], w)
        for name, value in want.items():
            assert r[name] == pytest.approx(value, rel=1e-9), (pid, k, name)


def test_empty_background_is_an_error(spark):
    with pytest.raises(ValueError):
        bg.require_background(bg.estimate_background(frame(spark, {}), ("pid",)))


@pytest.mark.parametrize("w,warmup", [(1, 0), (1, 20), (3, 0), (6, 4)])
def test_firing_position(spark, w, warmup):
    data = payloads(8, seed=3)
    cache = frame(spark, data)
    backgrounds = bg.estimate_background(cache, ("pid",), w, q_j=0.8)
    by_pid = {r.pid: r for r in backgrounds.collect()}
    want = {}
    for (pid, idx), d in data.items():
        b = by_pid[pid]
        for t in range(len(d["J_approx"])):
            if t < warmup or t + 1 < w or sum(d["J_approx"][t - w + 1 : t + 1]) <= b.lambda_J:
                continue
            zp = max(0, (d["Delta_path"][t] - b.mu_path) / (b.sig_path + 1e-6))
            zc = max(0, (d["G_cov"][t] - b.mu_cov) / (b.sig_cov + 1e-6))
            want[(pid, idx)] = (t, "path" if zp >= zc else "cov")
            break
    got = bg.firing_position(cache, backgrounds, w, warmup).collect()
    assert {(r.pid, r.rollout_idx): (r.t_hat, r.tau_hat) for r in got} == want and want


def test_replay_never_scores_the_last_token(spark):
    rows = [
        (pid, 0, t, 0.0, 0.0, j, "path", True, 0.5, 0.5, 2.0)
        for pid, js in {"late": [0, 0, 0, 5], "early": [0, 5, 9, 0], "never": [1, 1, 1, 1], "equal": [0, 2, 2, 0]}.items()
        for t, j in enumerate(map(float, js))
    ]
    df = spark.createDataFrame(
        rows,
        "pid string, rollout_idx long, t long, Z_path double, Z_cov double, J_t double, tau_t string, "
        "entropy_sensitive boolean, pS_on_set double, pA_on_set double, lambda_J double",
    )
    got = {r.pid: (r.t_hat, r.fire_score.S_t) for r in bg.online_replay(df, w=1, warmup=0).collect()}
    assert got == {"early": (1, 5.0)}
    wide = {r.pid: r.t_hat for r in bg.online_replay(df, w=2, warmup=2).collect()}
    assert wide == {"early": 2, "equal": 2}


def test_cache_round_trip_over_two_batches(spark, tmp_path):
    data = payloads()
    keys = sorted(data)
    path = str(tmp_path / "cache")
    for batch, part in enumerate((keys[:4], keys[4:])):
        fc.append_features(frame(spark, {k: data[k] for k in part}), path, "demo", "cell", batch)
    fc.append_features(frame(spark, {keys[0]: data[keys[0]]}), path, "demo", "other")
    cell = fc.scan_cell(spark, path, "demo", "cell")
    assert cell.count() == len(data)
    assert fc.is_cached(cell, "sample_3", 0) and not fc.is_cached(cell, "sample_3", 9)
    got = fc.lookup(cell, *keys[3]).first()
    assert np.allclose(got.logit_var, data[keys[3]]["logit_var"], atol=1e-5)
    a = trf.problem_profile(cell).toPandas().set_index("pid").sort_index()
    b = trf.problem_profile(frame(spark, data)).toPandas().set_index("pid").sort_index()
    assert np.abs(a - b).to_numpy().max() < 5e-3
    plan = cell._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(task" in plan


def test_last_batch_wins(spark, tmp_path):
    data = payloads(2)
    path = str(tmp_path / "cache")
    fc.append_features(frame(spark, data), path, "t", "m", 0)
    changed = {k: {**d, "entropy": [9.0] * len(d["entropy"])} for k, d in data.items()}
    fc.append_features(frame(spark, changed), path, "t", "m", 1)
    latest = fc.latest(fc.scan_cell(spark, path, "t", "m")).collect()
    assert len(latest) == 2 and all(set(r.entropy) == {9.0} for r in latest)


def test_sweep_records(spark):
    rows = [
        ("a", 1, "retry", False, None, None, False),
        ("a", 1, "geo_pred", True, 12, "cov", True),
        ("a", 1, "local_temp_1p5", False, 12, "cov", True),
        ("b", 1, "retry", False, None, None, False),
        ("b", 1, "geo_pred", False, None, None, False),
        ("c", 1, "retry", True, None, None, False),
    ]
    outcomes = spark.createDataFrame(
        rows, "pid string, k long, condition string, correct boolean, t_hat long, tau_hat string, fired boolean"
    )
    folded = {r.pid: r for r in sw.fold_results(outcomes, sw.BASE_CONDITIONS).collect()}
    assert folded["a"].geo_pred_tau_hat == "cov" and folded["b"].geo_pred_tau_hat is None
    assert folded["c"].geo_pred_correct is None
    plan = {(r.pid, r.offset): r.t_force for r in sw.ablation_plan(outcomes, 20).collect()}
    assert plan == {("a", -10): 20, ("a", -5): 20, ("a", 0): 20, ("a", 5): 20, ("a", 10): 22}
    results = spark.createDataFrame([("a", 1, 0, True), ("a", 1, 5, False)], "pid string, k long, offset long, correct boolean")
    ablation = {r.pid: r.ablation for r in sw.ablation_results(outcomes, results).collect()}
    assert ablation == {"a": {0: True, 5: False}, "b": {}, "c": {}}
    regimes = {r.pid: r.regime for r in sw.regimes(sw.rescue_flags(outcomes)).collect()}
    assert regimes == {"a": "STEERABLE", "b": "HARD", "c": "SAMPLING"}
    folded_map = {r.pid: r.results for r in sw.fold_results_map(outcomes.selectExpr("*", "5 AS n_tokens")).collect()}
    assert folded_map["a"]["geo_pred"].t_hat == 12 and set(folded_map["b"]) == {"retry", "geo_pred"}


def test_request_plan_arms_and_draws(spark):
    cases = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1)], "pid string, k long")
    full = sw.request_plan(cases).collect()
    assert len(full) == 3 * 7 and len({r.req_key for r in full}) == 21
    assert sw.request_plan(cases, operators=["geo"]).count() == 3 * 4
    for r in full:
        assert (r.condition == "rand") == (r.rand_t is not None) == (r.rand_tau is not None)
        if r.rand_t is not None:
            assert 20 <= r.rand_t <= 512
    assert sorted(full) == sorted(sw.request_plan(cases.repartition(3)).collect())
    assert math.isclose(sum(r.T_local or 0 for r in full), 3 * 4.5)


def test_rescue_flags_of_records_equal_those_of_single_outcomes(spark):
    import random

    from tracefork.operators import sweep as sw

    rng = random.Random(21)
    names = ["retry", "rand", "geo_pred", "geo_wrong", "local_temp_1p0", "local_temp_2p0", "dense"]
    rows = [(f"p{i % 9}", i, *[rng.choice([True, False, False, False, None]) for _ in names]) for i in range(30)]
    rows.append(("none", 99, *[None] * len(names)))
    records = spark.createDataFrame(rows, "pid string, k long, " + ", ".join(f"{n} boolean" for n in names))
    single = records.unpivot(["pid", "k"], names, "condition", "correct")
    wide = sw.rescue_flags_of_records(records, {n: records[n] for n in names})
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(wide) == key(sw.rescue_flags(single).select(*wide.columns))


def test_rescued_at_any_k_moves_one_row_per_problem(spark):
    rows = [
        ("a", 1, "retry", False), ("a", 2, "retry", True), ("a", 2, "retry", None), ("a", 1, "rand", None),
        ("a", 1, "dense", False), ("a", 1, "own arm", True), ("a", 2, "own arm", False), ("a", 1, "other arm", None),
        ("a", 1, None, False), (None, 1, "retry", True), (None, 1, None, None), ("b", 1, "local_temp_2p0", True),
    ]
    df = spark.createDataFrame(rows, "pid string, k bigint, condition string, correct boolean")
    got = sw.rescued_any_k(df)
    plain = df.groupBy("pid", "condition").agg(F.bool_or("correct").alias("rescued"))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert got.dtypes == plain.dtypes
    got.collect()
    told = got._jdf.queryExecution().executedPlan().toString()
    assert "condition#" not in told.split("hashpartitioning(", 1)[1].split(")")[0]


def test_fold_moves_flags_as_bits_and_keeps_every_field(spark):
    rows = [
        ("p1", 1, "retry", True, False, None, None, 5),
        ("p1", 1, "retry", False, None, None, None, 9),  # an attempt twice: each field's own maximum
        ("p1", 1, "geo_pred", False, True, 40, "path", 7),
        ("p1", 1, "geo_pred", None, True, 30, "cov", None),
        ("p1", 1, "other", True, True, 99, "path", 99),
        ("p2", 1, "rand", None, None, None, None, None),
        (None, 1, "geo_wrong", False, True, 21, "cov", 3),
    ]
    df = spark.createDataFrame(rows, "pid string, k long, condition string, correct boolean, fired boolean, t_hat long, tau_hat string, n_tokens long")
    fields = ("correct", "n_tokens", "fired", "t_hat", "tau_hat")
    for conditions in (sw.BASE_CONDITIONS, [*sw.BASE_CONDITIONS, *[f"arm_{i}" for i in range(30)]]):
        got = sw.fold_results(df, conditions, fields)
        plain = df.groupBy("pid", "k").agg(
            *[F.max(F.when(F.col("condition") == c, F.col(f))).alias(f"{c}_{f}") for c in conditions for f in fields]
        )
        assert got.columns == plain.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    plan = sw.fold_results(df, sw.BASE_CONDITIONS, fields)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "max(CASE WHEN (condition#" in plan
    assert "THEN correct" not in plan.split("Aggregate", 1)[1].split("\n", 1)[0]


def test_full_records_number_the_lines_once_and_agree_flat(spark, tmp_path):
    from tracefork.catalog import inputs, sweep_queries

    rng = random.Random(5)
    lines = [
        (o, rng.randrange(1, 9999), rng.randrange(1, 99), n, float(rng.randrange(1, 51)), rng.random())
        for o in range(40) for n in range(1 + o % 7)
    ]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines + lines[:9], kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sweep_queries.h4_full(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression [pid") >= 4
    found = {(r.pid, r.k): r for r in got.collect()}
    assert len(found) == len(lines) + 9
    outcomes = inputs.outcomes(spark, str(tmp_path)).collect()
    assert len(outcomes) == 7 * len(found)
    for o in outcomes:
        r = found[o.pid, o.k]
        for f in ("correct", "n_tokens", "fired", "t_hat", "tau_hat"):
            assert r[f"{o.condition}_{f}"] == o[f]
        assert r[f"{o.condition}_S_t"] == (o.t_hat / 8 if o.fired else None)
        assert r[f"{o.condition}_T_local"] == (float(o.condition[11:].replace("p", ".")) if o.condition[:5] == "local" else None)
    for r in found.values():
        fired = r.geo_pred_fired
        assert r.ablations == (5 if fired else 0) and (r.dense_correct is not None) == fired
        assert r.ablations_right == (sum((r.geo_pred_t_hat + o) % 3 == 0 for o in sw.ABLATION_OFFSETS) if fired else 0)
        assert (r.lambda_J is None) == (r.k > 3)
