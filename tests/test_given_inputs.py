"""Inputs as files and engines give them: extra keys, other spellings, repeated ids, missing parts, extreme settings."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tracefork.functions import arrays as A
from tracefork.functions.answers import exact_match, python_problem_check
from tracefork.operators import mixing as mx
from tracefork.operators import selection as sel
from tracefork.operators import token_features as tf
from tracefork.schemas import CACHE_ARRAYS, PROFILE, TOPK
from tracefork.sources import feature_cache as fc
from tracefork.sources import jsonl
from tracefork.sources.profiles import load_profiles


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


PROBLEMS = [
    {"problem_id": 1, "prompt": "p", "answer": "1", "subject": "algebra", "level": 3, "tags": ["x", "2"], "limits": {"low": 0}},
    "",
    {"id": "2", "question": "q", "answer": "7", "subject": "geometry", "level": 5},
    {"pid": "1", "input": "again", "answer": "0", "subject": "number theory", "level": 4},
]


def test_extra_keys_of_problems(spark, tmp_path):
    rows = jsonl.load_problems(spark, write(tmp_path / "p.jsonl", PROBLEMS)).orderBy("line").collect()
    assert [(r.problem_id, r.prompt, r.line) for r in rows] == [("1", "p", 0), ("2", "q", 1), ("1", "again", 2)]
    assert rows[0].extra == {"subject": "algebra", "level": "3", "tags": '["x","2"]', "limits": '{"low":0}'}
    assert json.loads(rows[1].raw)["level"] == 5


def test_flags_and_extra_keys_of_rollouts(spark, tmp_path):
    lines = [
        {"problem_id": "1", "generated_text": "a", "is_correct": 1, "note": "n"},
        {"problem_id": "1", "generated_text": "b", "is_correct": 0},
        {"problem_id": "1", "generated_text": "c", "is_correct": True, "rollout_idx": 9},
        {"problem_id": "1", "generated_text": "d", "is_correct": None},
    ]
    rows = jsonl.load_rollouts(spark, write(tmp_path / "r.jsonl", lines)).orderBy("generated_text").collect()
    assert [(r.rollout_idx, r.is_correct) for r in rows] == [(0, True), (1, False), (9, True), (3, None)]
    assert rows[0].extra == {"note": "n"}


def test_the_last_line_of_a_repeated_problem_counts(spark, tmp_path):
    problems = jsonl.load_problems(spark, write(tmp_path / "p.jsonl", PROBLEMS))
    rollouts = spark.createDataFrame([("1", 0, "it is 1", None), ("1", 1, "it is 0", None), ("2", 0, "it is 7", None), ("3", 0, "x", None)], "problem_id string, rollout_idx long, generated_text string, is_correct boolean")
    failed = sel.failures(rollouts, problems, exact_match).collect()
    assert sorted((r.problem_id, r.rollout_idx) for r in failed) == [("1", 0), ("3", 0)]
    marked = sel.mark_correct(rollouts, problems.drop("line"), exact_match).collect()  # without lines: the larger answer
    assert {(r.problem_id, r.rollout_idx): r.ok for r in marked}["1", 0]


def test_a_check_sees_the_problem_as_it_is_in_the_file(spark, tmp_path):
    problems = jsonl.load_problems(spark, write(tmp_path / "p.jsonl", PROBLEMS))

    def check(problem, text):
        if not problem:
            return False
        assert "raw" not in problem and "line" not in problem and "extra" not in problem
        return problem["subject"] == text and problem["level"] + 0 in (4, 5) and problem["prompt"] in ("q", "again")

    rollouts = spark.createDataFrame([("1", 0, "number theory", None), ("1", 1, "algebra", None), ("2", 0, "geometry", None), ("9", 0, "x", None)], "problem_id string, rollout_idx long, generated_text string, is_correct boolean")
    marked = sel.mark_correct(rollouts, problems, python_problem_check(check)).collect()
    assert {(r.problem_id, r.rollout_idx): r.ok for r in marked} == {("1", 0): True, ("1", 1): False, ("2", 0): True, ("9", 0): False}


def test_keys_fall_back_past_empty_ids(spark):
    rows = [("", "p2", "x", 1, None), (None, "", "i3", 4, "text")]
    df = spark.createDataFrame(rows, "problem_id string, pid string, id string, rollout_id long, answer string")
    got = [(r.pid, r.rollout_idx, r.generated_text) for r in sel.normalise_keys(df).collect()]
    assert sorted(got) == [("i3", 4, "text"), ("p2", 1, "")]


def test_one_prompt_for_a_repeated_problem(spark):
    rollouts = spark.createDataFrame([("a", 0, [9]), ("a", 1, [8, 7])], "pid string, rollout_idx long, output_ids array<int>")
    prompts = spark.createDataFrame([("a", [1, 2]), ("a", [1, 2]), ("b", [3])], "pid string, prompt_ids array<int>")
    built = sel.build_sequences(rollouts, prompts).collect()
    assert sorted((r.rollout_idx, r.prompt_len, r.full_ids) for r in built) == [(0, 2, [1, 2, 9]), (1, 2, [1, 2, 8, 7])]


def test_appends_without_a_number_come_after_all(spark, tmp_path):
    path = str(tmp_path / "cache")

    def put(value, **options):
        row = spark.createDataFrame([("p", 0, *[[value]] * len(CACHE_ARRAYS))], "pid string, rollout_idx long, " + ", ".join(f"{c} array<double>" for c in CACHE_ARRAYS))
        fc.append_features(row, path, "t", "m", **options)

    put(1.0, batch=4)
    put(2.0)
    put(3.0)
    cell = fc.scan_cell(spark, path, "t", "m")
    assert sorted(r.shard for r in cell.collect()) == [4, 5, 6]
    assert [r.V for r in fc.lookup(cell, "p", 0).collect()] == [[3.0]]


def test_bad_numbers_in_a_profile_file(spark, tmp_path):
    path = write(tmp_path / "bad.csv", [",".join(PROFILE.names), "m|t,m,t,1,three,0.5,1.2,-0.7,0.1,0.2,0.3,0.4,0.5"])
    with pytest.raises(Exception, match="(?i)malformed"):
        load_profiles(spark, path).collect()


def test_features_at_a_very_low_temperature(spark):
    lists = {"S": [(1, -0.1), (2, -3.0), (3, -9.0)], "A": [(2, -0.2), (1, -2.0), (4, -8.0)]}
    rows = [("p", 0, 5, m, t, lp, i + 1) for m, own in lists.items() for i, (t, lp) in enumerate(own)]
    taken = spark.createDataFrame([("p", 0, 0, 5, 1)], "pid string, rollout_idx long, t long, pos long, x_t long")
    row = tf.token_features(spark.createDataFrame(rows, TOPK), taken, 0.01, 2).first()
    assert all(math.isfinite(row[c]) for c in CACHE_ARRAYS)
    log_z = {m: max(lp for _, lp in own) / 0.01 + math.log(sum(math.exp((lp - max(x for _, x in own)) / 0.01) for _, lp in own)) for m, own in lists.items()}
    assert row.Delta_path == pytest.approx((-0.1 / 0.01 - log_z["S"]) - (-2.0 / 0.01 - log_z["A"]), rel=1e-6)


def test_without_ancestor_logits_the_specialist_stands(spark):
    rows = [("p", 0, t, [1.0, -2.0, 3.0], None if t % 3 == 0 else [0.5, 0.5, -1.0]) for t in range(9)]
    pairs = spark.createDataFrame(rows, "pid string, rollout_idx long, t long, z_s array<double>, z_a array<double>")
    ids = F.array(F.lit(2), F.lit(-1), F.lit(0))
    for weight in (0.25, 1.0):
        got = pairs.select("t", mx.cross_vocabulary(F.col("z_s"), F.col("z_a"), ids, weight).alias("z")).collect()
        for r in got:
            mapped = [-1.0, None, 0.5] if r.t % 3 else None
            if mapped is None:
                assert r.z == [1.0, -2.0, 3.0]
            elif weight == 1.0:
                assert [r.z[0], r.z[2]] == [-1.0, 0.5] and r.z[1] <= A.NEG_INF
            else:
                assert r.z == [0.5, -2.0, 0.75 * 3.0 + 0.25 * 0.5]


@pytest.mark.parametrize("mode", ["logit_mix", "prob_mix", "adaptive_logit_mix", "adaptive_prob_mix", "min_p", "top_p", "reppen"])
def test_injection_with_a_third_of_the_ancestor_rows_absent(spark, mode):
    rows = [("p", 0, t, [1.0, -2.0, 3.0, 0.0], None if t % 3 == 0 else [0.5, 0.5, -1.0, 2.0]) for t in range(9)]
    pairs = spark.createDataFrame(rows, "pid string, rollout_idx long, t long, z_s array<double>, z_a array<double>")
    sequences = spark.createDataFrame([("p", 0, [2, 2, 1, 1, 2, 2, 2, 2, 2])], "pid string, rollout_idx long, output_ids array<int>")
    prompts = spark.createDataFrame([("p", [3, 900])], "pid string, prompt_ids array<int>")
    starts = spark.createDataFrame([("p", 0, 2)], "pid string, rollout_idx long, t_start long")
    seen = mx.with_seen(pairs, sequences, prompts)
    out = mx.inject(seen, starts, mode, width=5, min_p_value=0.1, top_p_value=0.6, penalty=2.0, sampling=True)
    for r in out.collect():
        assert r.in_window == (2 <= r.t < 7) and len(r.z_out) == 4
        if not r.in_window or (r.z_a is None and mode.endswith("mix")):
            assert r.z_out == r.z_s
        elif mode == "reppen":
            ids = {3, *[2, 2, 1, 1, 2, 2, 2, 2, 2][: r.t]}
            assert r.z_out == [(z / 2 if z > 0 else z * 2) if i in ids else z for i, z in enumerate(r.z_s)]
        elif mode in ("min_p", "top_p"):
            assert r.z_out[2] == 3.0 and r.z_out[1] <= A.NEG_INF
        else:
            assert r.z_out != r.z_s


def cache_rows(spark, pids, value):
    rows = [(p, 0, *[[value]] * len(CACHE_ARRAYS)) for p in pids]
    return spark.createDataFrame(rows, "pid string, rollout_idx long, " + ", ".join(f"{c} array<double>" for c in CACHE_ARRAYS))


def test_indexed_lookups_read_the_files_that_hold_the_keys(spark, tmp_path):
    path, index, target, second = (str(tmp_path / n) for n in ("cache", "index", "compacted", "index2"))
    pids = [f"p{i:03d}" for i in range(60)]
    fc.append_features(cache_rows(spark, pids, 1.0), path, "t", "m", rows_per_file=5)
    fc.refresh_index(spark, path, "t", "m", index)
    fc.append_features(cache_rows(spark, pids[:6], 2.0), path, "t", "m", rows_per_file=5)
    fc.refresh_index(spark, path, "t", "m", index)
    fc.refresh_index(spark, path, "t", "m", index)  # knows all files already
    assert spark.read.parquet(index).count() == 66
    keys = [("p003", 0), ("p050", 0), ("none", 0)]
    found = fc.indexed_lookup(spark, path, index, keys)
    assert sorted((r.pid, r.V) for r in found.collect()) == [("p003", [2.0]), ("p050", [1.0])]
    assert len([f for f in found.inputFiles() if "/cache/" in f]) == 2 < len(fc.scan_cell(spark, path, "t", "m").inputFiles())
    fc.compact(spark, path, "t", "m", target)
    fc.refresh_index(spark, target, "t", "m", second)
    again = fc.indexed_lookup(spark, target, second, keys)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))
    assert fc.scan_cell(spark, target, "t", "m").count() == 60
    assert fc.indexed_lookup(spark, target, second, [("none", 0)]).collect() == []


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "cache")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda _: fc.claim_shard(spark, path, "t", "m"), range(8)))
    assert sorted(numbers) == list(range(8))
    fc.append_features(cache_rows(spark, ["a"], 1.0), path, "t", "m")
    assert [r.shard for r in fc.scan_cell(spark, path, "t", "m").collect()] == [8]


def test_winners_are_chosen_without_the_arrays(spark, tmp_path):
    path = str(tmp_path / "cache")
    twice = cache_rows(spark, ["a"], 1.0).union(cache_rows(spark, ["a"], 4.0)).coalesce(1)
    fc.append_features(twice, path, "t", "m")
    newest = fc.latest(fc.scan_cell(spark, path, "t", "m"))
    assert newest.count() == 1
    plan = newest._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftSemi" in plan


def test_blocks_of_positions_that_both_models_have(spark):
    rows = []
    for pos in range(11):
        for model in "SA":
            if (model, pos) in (("S", 3), ("A", 7), ("A", 8)):
                continue
            for rank in range(1, 3 + (pos % 2)):
                rows.append(("p", 0, pos, model, 10 * pos + rank, -0.5 * rank, rank))
    rows.append(("q", 0, 0, "S", 1, -1.0, 1))  # the other model has nothing
    blocks = tf.capture_blocks(spark.createDataFrame(rows, TOPK), rows=4)
    got = {(r.block, r.model): r for r in blocks.collect()}
    assert sorted(got) == [(0, "A"), (0, "S"), (1, "A"), (1, "S")]
    assert got[0, "S"].positions == got[0, "A"].positions == [0, 1, 2, 4]
    assert got[1, "S"].positions == [5, 6, 9, 10]
    first = got[0, "S"]
    assert first.k == 3 and len(first.topk_logprobs) == len(first.topk_token_ids) == 12
    assert first.topk_token_ids == [1, 2, -1, 11, 12, 13, 21, 22, -1, 41, 42, -1]
    cells = [(r.pos, r.slot) for r in tf.capture_entries(blocks).where("token_id >= 0 and model = 'A'").collect()]
    assert sorted(cells) == sorted((r[2], r[6] - 1) for r in rows if r[3] == "A" and r[2] != 3)
