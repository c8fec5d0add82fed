"""Per-token features against a direct evaluation of their definitions."""

import math
import random

import pytest

from tracefork.operators import token_features as tf
from tracefork.schemas import TOPK

TEMP, K_COV, FLOOR = 0.6, 3, -1000.0


def random_lists(seed, positions, vocab=30, k=8):
    """{pos: (S, A)} with each a list of (token, logprob, rank); lists overlap only in part."""
    rng = random.Random(seed)
    out = {}
    for pos in range(positions):
        sides = []
        for _ in range(2):
            tokens = rng.sample(range(vocab), k)
            lps = sorted((math.log(rng.random()) - 0.5 for _ in tokens), reverse=True)
            sides.append([(t, lp, i + 1) for i, (t, lp) in enumerate(zip(tokens, lps))])
        out[pos] = tuple(sides)
    return out


def expected(s, a, x):
    ls, la = {t: lp for t, lp, _ in s}, {t: lp for t, lp, _ in a}
    lse_s = math.log(sum(math.exp(v / TEMP) for v in ls.values()))
    lse_a = math.log(sum(math.exp(v / TEMP) for v in la.values()))
    log_s = lambda t: ls.get(t, FLOOR) / TEMP - lse_s
    log_a = lambda t: la.get(t, FLOOR) / TEMP - lse_a
    p = {t: math.exp(log_s(t)) for t in ls}
    mean = sum(p[t] * ls[t] for t in ls)
    mu = [sum(p[t] * (ls[t] - mean) ** n for t in ls) for n in range(5)]
    cover = [t for t, _ in sorted(la.items(), key=lambda e: -e[1])[:K_COV]]
    mass_a, mass_s = (sum(math.exp(f(t)) for t in cover) for f in (log_a, log_s))
    delta, gap = log_s(x) - log_a(x), math.log((mass_a + 1e-8) / (mass_s + 1e-8))
    return {
        "Delta_path": delta,
        "V": math.exp(log_s(x)),
        "logit_var": mu[2],
        "logit_skew": mu[3],
        "logit_kurt": mu[4] - 3 * mu[2] ** 2,
        "entropy": -sum(v * math.log(v) for v in p.values()),
        "kl_div": max(0.0, sum(p[t] * (math.log(p[t]) - log_a(t)) for t in p)),
        "pA_on_set": mass_a,
        "G_cov": gap,
        "J_approx": max(delta, 0) + max(gap, 0),
    }


def tables(spark, lists, taken, ranked=True):
    rows = [
        ("p", 0, pos, model, t, lp, rank if ranked else None)
        for pos, sides in lists.items()
        for model, side in zip("SA", sides)
        for t, lp, rank in side
    ]
    marks = [("p", 0, i, pos, x) for i, (pos, x) in enumerate(taken)]
    return spark.createDataFrame(rows, TOPK), spark.createDataFrame(
        marks, "pid string, rollout_idx long, t long, pos long, x_t long"
    )


@pytest.mark.parametrize("ranked", [True, False])
def test_features_match_their_definitions(spark, ranked):
    lists = random_lists(1, 12)
    rng = random.Random(2)
    # taken tokens: in both lists, in one, or in neither
    taken = [(pos, rng.choice([lists[pos][0][0][0], lists[pos][1][1][0], 29])) for pos in lists]
    topk, marks = tables(spark, lists, taken, ranked)
    got = {r.pos: r for r in tf.token_features(topk, marks, TEMP, K_COV).collect()}
    assert len(got) == len(taken)
    for pos, x in taken:
        for name, value in expected(*lists[pos], x).items():
            assert got[pos][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (pos, name)


def test_positions_without_both_lists_or_past_the_end_are_skipped(spark):
    lists = random_lists(3, 6)
    topk, marks = tables(spark, lists, [(pos, 1) for pos in range(8)])
    topk = topk.where("NOT (pos = 2 AND model = 'A')").where("pos <> 4")
    out = tf.token_features(topk, marks, TEMP, K_COV)
    assert sorted(r.pos for r in out.collect()) == [0, 1, 3, 5]
    trace = tf.assemble_traces(out).first()
    assert len(trace.J_approx) == 4


def test_rollout_without_valid_position_is_dropped(spark):
    topk, marks = tables(spark, random_lists(4, 3), [(0, 1)])
    assert tf.assemble_traces(tf.token_features(topk.where("model = 'S'"), marks)).count() == 0


def test_point_mass_has_no_spread(spark):
    lists = {0: ([(5, -3.0, 1)], [(5, -0.1, 1)])}
    row = tf.token_features(*tables(spark, lists, [(0, 5)]), TEMP, K_COV).first()
    for name in ("logit_var", "logit_skew", "entropy", "kl_div", "Delta_path"):
        assert row[name] == pytest.approx(0.0, abs=1e-12), name


def test_partial_ranks_fall_back_only_where_none_is_usable(spark):
    lists = random_lists(5, 2)
    topk, marks = tables(spark, lists, [(0, 1), (1, 1)])
    # position 0 loses its ranks, position 1 keeps a single usable rank
    topk = topk.selectExpr(
        "pid", "rollout_idx", "pos", "model", "token_id", "logprob",
        "CASE WHEN pos = 1 AND rank = 2 THEN rank WHEN pos = 1 THEN rank + 50 END AS rank",
    )
    got = {r.pos: r.pA_on_set for r in tf.token_features(topk, marks, TEMP, K_COV).collect()}
    assert got[0] == pytest.approx(expected(*lists[0], 1)["pA_on_set"])
    a = {t: lp for t, lp, _ in lists[1][1]}
    lse = math.log(sum(math.exp(v / TEMP) for v in a.values()))
    assert got[1] == pytest.approx(math.exp(lists[1][1][1][1] / TEMP - lse))


def test_capture_pads_to_the_longest_position(spark):
    lists = random_lists(6, 2, k=4)
    lists[1] = (lists[1][0][:2], lists[1][1])
    topk, _ = tables(spark, lists, [(0, 1)])
    row = tf.capture_topk(topk).where("model = 'S'").first()
    assert row.topk_token_ids[1][2:] == [-1, -1]
    assert row.topk_logprobs[1][2:] == [FLOOR, FLOOR]
    assert row.topk_token_ids[0] == [t for t, _, _ in lists[0][0]]
    assert row.T_extracted == 0.6
