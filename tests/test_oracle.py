"""Registered queries against their SQL oracle on the smallest tables.

One or two of each family by default; ORACLE_ALL=1 runs every query (about seven minutes).
"""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect
from tracefork import catalog

SAMPLE = [
    "a4_line_numbers", "a5_a7_cache_scan", "a8_last_shard_wins", "a11_raw_capture", "a12_logit_windows", "a17_fire_read_back",
    "b3_numeric_answer", "b5_failures", "b12_features_with_gaps", "b14_eligible_pairs", "c10_features_without_ranks",
    "c_token_features", "c20_temperature_susceptibility", "d10_problem_profile", "d9_routing_features", "e5_background",
    "e6_firing_position", "e11_online_replay", "f1_outcome_contrast", "f5_demotion_top_decile", "f12_page_hinkley",
    "f17_joint_calibration", "g8_adaptive_prob_mix", "g15_top_p", "g20_sparse_steer", "h1_request_plan", "h6_ablation_results",
    "h10_regimes", "i1_online_page_hinkley", "j8_taxonomy", "j13_fixed_rates", "j14_verdict",
]
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.load()[0]) if os.environ.get("ORACLE_ALL") else SAMPLE)
def test_query_matches_oracle(spark, con, name):
    difference, rows = compare(spark, con, name, SF_DIR)
    assert difference == ""
    assert rows >= 0


def test_only_the_projection_has_no_oracle():
    queries, oracle = catalog.load()
    assert set(queries) - set(oracle) == {"j17_principal_plane"}


def test_entry_has_a_verdict_per_cell(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
    assert all(r.routing_wins == (r.delta_pp >= 0) for r in rows)
