"""Steering arithmetic against numpy, with ties, missing vocabulary and extreme settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefork.functions import arrays as A
from tracefork.operators import detectors as dt
from tracefork.operators import mixing as mx

RNG = np.random.default_rng(4)
Z_S, Z_A = RNG.normal(0, 3, (6, 12)), RNG.normal(0, 3, (6, 12))
Z_S[0, 3] = Z_S[0, 7] = 9.0  # tied maximum
Z_S[1, :] = 0.5  # uniform


def soft(z, t=1.0):
    e = np.exp((z - z.max(-1, keepdims=True)) / t)
    return e / e.sum(-1, keepdims=True)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("p", 0, t, int(t), s.tolist(), a.tolist()) for t, (s, a) in enumerate(zip(Z_S, Z_A))]
    return spark.createDataFrame(rows, "pid string, rollout_idx long, t long, x_t long, z_s array<double>, z_a array<double>")


def run(pairs, column):
    return np.array([r.v for r in pairs.select("t", column.alias("v")).orderBy("t").collect()], dtype=float)


def both():
    return F.col("z_s"), F.col("z_a")


def test_signals(pairs):
    p_s, p_a = soft(Z_S), soft(Z_A)
    h = lambda p: -(p * np.log(p + 1e-10)).sum(-1)
    assert np.allclose(run(pairs, mx.entropy_gap(*both())), h(p_s) - h(p_a))
    chi = (p_a**2 / (p_s + 1e-10)).sum(-1) - 1
    assert np.allclose(run(pairs, mx.chi2(*both())), chi)
    alpha = 1 / (1 + np.exp(-np.clip(-chi / 2 + np.log(0.7 / 0.3), -4.6, 4.6)))
    assert np.allclose(run(pairs, mx.adaptive_alpha(-mx.chi2(*both()), 2.0)), alpha)
    assert run(pairs, mx.adaptive_alpha(F.lit(0.0)))[0] == pytest.approx(0.7)


def test_mixes(pairs):
    assert np.allclose(run(pairs, mx.logit_mix(*both(), 0.3)), 0.3 * Z_S + 0.7 * Z_A)
    mix = np.maximum(0.3 * soft(Z_S, 0.6) + 0.7 * soft(Z_A, 0.6), 1e-12)
    assert np.allclose(run(pairs, mx.prob_mix(*both(), 0.3, 0.6)), np.log(mix))
    assert np.allclose(run(pairs, mx.prob_mix(*both(), 0.3, 0.6, rescale=True)), 0.6 * np.log(mix))
    assert np.allclose(run(pairs, mx.prob_mix(*both(), 0.3, 1e-6, rescale=True)), 0.3 * Z_S + 0.7 * Z_A)
    kept = run(pairs, mx.prob_mix(*both(), 0.3, protected=[2, 5]))
    assert np.allclose(kept[:, [2, 5]], np.log(np.maximum(soft(Z_S), 1e-12))[:, [2, 5]])
    assert np.allclose(run(pairs, mx.steer(F.lit("path"), *both(), 0.3)), 0.3 * Z_S + 0.7 * Z_A)
    assert np.allclose(run(pairs, mx.steer(F.lit("cov"), *both(), 0.3)), np.log(mix))


def test_vocabulary_alignment(pairs):
    padded = run(pairs, mx.aligned(F.col("z_s"), F.slice("z_a", 1, 9)))
    assert np.allclose(padded[:, :9], Z_A[:, :9]) and np.isneginf(padded[:, 9:]).all()
    assert np.allclose(run(pairs, mx.aligned(F.slice("z_s", 1, 5), F.col("z_a"))), Z_A[:, :5])


def test_cross_vocabulary(pairs):
    ids = np.array([3, -1, 0, 99, 11, -1, 2, 2, 5, 1, 7, 4])
    column = F.array(*[F.lit(int(i)) for i in ids])
    looked = Z_A[:, np.clip(ids, 0, 11)]
    blend = np.where(ids == -1, Z_S, 0.6 * Z_S + 0.4 * looked)
    assert np.allclose(run(pairs, mx.cross_vocabulary(*both(), column, 0.4)), blend)
    hard = run(pairs, mx.cross_vocabulary(*both(), column, 1.0))
    assert np.isneginf(hard[:, ids == -1]).all() and np.allclose(hard[:, ids != -1], looked[:, ids != -1])


def test_filters(pairs):
    p = soft(Z_S)
    assert np.array_equal(run(pairs, mx.min_p(F.col("z_s"), 0.2)) > -np.inf, p >= 0.2 * p.max(-1, keepdims=True))
    for limit in (0.0, 0.5, 0.9, 1.0):
        keep = np.zeros_like(p, dtype=bool)
        for i, row in enumerate(p):
            order = np.argsort(-row, kind="stable")
            total = 0.0
            for j in order:
                if total > limit:
                    break
                keep[i, j] = True
                total += row[j]
        assert np.array_equal(run(pairs, mx.top_p(F.col("z_s"), limit)) > -np.inf, keep), limit


def test_repetition_penalty(pairs):
    seen = [0, 3, 8]
    out = run(pairs, mx.repetition_penalty(F.col("z_s"), F.array(*[F.lit(i).cast("bigint") for i in seen]), 1.5))
    want = Z_S.copy()
    want[:, seen] = np.where(Z_S[:, seen] > 0, Z_S[:, seen] / 1.5, Z_S[:, seen] * 1.5)
    assert np.allclose(out, want)


def test_injection_window_and_rejected_option(spark, pairs):
    starts = spark.createDataFrame([("p", 0, 2)], "pid string, rollout_idx long, t_start long")
    rows = mx.inject(pairs, starts, "prob_mix", width=2, alpha=0.9, temperature=0.5).orderBy("t").collect()
    assert [r.t for r in rows if r.in_window] == [2, 3]
    mixed = np.log(0.9 * soft(Z_S / 0.5) + 0.1 * soft(Z_A / 0.5) + 1e-12)
    assert np.allclose(rows[2].z_out, mixed[2]) and np.allclose(rows[4].z_out, 100 * Z_S[4])
    with pytest.raises(ValueError, match="inject_top_k"):
        mx.inject(pairs, starts, "min_p", inject_top_k=5)


def test_greedy_ties_go_to_the_smaller_token(pairs):
    got = run(pairs, A.argmax(F.col("z_s")))
    assert got[0] == 3 and got[1] == 0 and np.array_equal(got, Z_S.argmax(-1))


def test_diagnostics(pairs):
    a = 1 / (1 + np.exp(-np.array([-2.0, 0.0, 1.0, 2.0, 3.0, -1.0])))
    column = 1 / (1 + F.exp(-F.element_at(F.array(*[F.lit(v) for v in (-2.0, 0.0, 1.0, 2.0, 3.0, -1.0)]), (F.col("t") + 1).cast("int"))))
    row = mx.mixing_diagnostics(pairs, column).first()
    mix = a[:, None] * soft(Z_A) + (1 - a)[:, None] * soft(Z_S)
    assert row.H_mix == pytest.approx(np.mean(-(mix * np.log(mix + 1e-10)).sum(-1)))
    assert row.alpha_std == pytest.approx(a.std(ddof=1)) and row.frac_dominant == pytest.approx((a > 0.5).mean())


def test_detectors(pairs, spark):
    d = np.log(soft(Z_S))[np.arange(6), np.arange(6)] - np.log(soft(Z_A))[np.arange(6), np.arange(6)]
    scored = dt.demotion_scores(pairs)
    assert np.allclose(run(scored, F.col("d_t")), d)
    missing = scored.withColumn("d_t", F.when(F.col("t") != int(np.argmax(d)), F.col("d_t")))
    order = sorted((t for t in range(6) if t != int(np.argmax(d))), key=lambda t: -d[t]) + [int(np.argmax(d))]
    assert [r.t for r in dt.select_top(missing, "d_t", 6).orderBy("place").collect()] == order
    gap = [np.maximum(a - s, 0)[np.argsort(-a, kind="stable")[:5]].sum() for a, s in zip(soft(Z_A), soft(Z_S))]
    assert np.allclose(run(dt.coverage_gap(pairs), F.col("c_t")), gap)
    refs = spark.createDataFrame([("p", i, 5 * i, 60) for i in range(12)], "pid string, rollout_idx long, ref_step long, length long")
    for r in dt.matched_position(refs).collect():
        assert max(0, r.ref_step - 3) <= r.step <= min(59, r.ref_step + 3)
    short = spark.createDataFrame([("p", 0, 0), ("p", 1, 1)], "pid string, rollout_idx long, length long")
    assert {r.step for r in dt.random_position(short).collect()} == {0}
