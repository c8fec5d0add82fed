"""JSON lines, CSV profiles, correctness checks and selection, edge cases included."""

import json

import pytest
from pyspark.sql import functions as F

from tracefork.functions import answers as an
from tracefork.operators import selection as sel
from tracefork.schemas import LOGIT_WINDOW, PROBLEM_FILE, PROFILE
from tracefork.sources import feature_cache as fc
from tracefork.sources import jsonl
from tracefork.sources.profiles import load_profiles, load_records


def write_lines(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_problem_aliases_and_blank_lines(spark, tmp_path):
    path = write_lines(
        tmp_path / "p.jsonl",
        [{"problem_id": 7, "prompt": "a", "answer": "1"}, "", "   ", {"pid": "x", "question": "b"}, {"id": "y", "input": "c"}, {"answer": "z"}],
    )
    rows = {(r.problem_id, r.prompt, r.answer) for r in jsonl.load_problems(spark, path).collect()}
    assert rows == {("7", "a", "1"), ("x", "b", None), ("y", "c", None), ("", "", "z")}


def test_bad_json_fails(spark, tmp_path):
    path = write_lines(tmp_path / "bad.jsonl", ['{"problem_id": "1"}', '{"problem_id": '])
    with pytest.raises(Exception):
        jsonl.load_jsonl(spark, path, PROBLEM_FILE).collect()


def test_rollout_line_numbers_skip_blank_lines(spark, tmp_path):
    path = write_lines(
        tmp_path / "r.jsonl",
        [{"pid": "a", "answer": "one"}, "", {"pid": "a", "rollout_id": 9, "generated_text": "two"}, {"pid": "b", "is_correct": True}, {"id": "c", "is_correct": None}],
    )
    rows = jsonl.load_rollouts(spark, path).orderBy("rollout_idx").collect()
    assert [(r.problem_id, r.rollout_idx, r.generated_text, r.is_correct) for r in rows] == [
        ("a", 0, "one", None), ("b", 2, None, True), ("c", 3, None, None), ("a", 9, "two", None)
    ]


def test_line_numbers_across_splits(spark, tmp_path):
    path = write_lines(tmp_path / "many.txt", [f"line {i:05d}" if i % 5 else "" for i in range(4000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = jsonl.numbered_lines(spark, path)
        rows = sorted((r.value, r.line) for r in df.collect())
        assert spark.read.text(path).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [n for _, n in rows] == list(range(3200))


def test_nulls_survive_saving(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("2", "x")], "problem_id string, answer string")
    jsonl.save_jsonl(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"answer":null' in text


def test_metadata_log_starts_empty(spark, tmp_path):
    path, schema = str(tmp_path / "meta"), spark.createDataFrame([], "k string, n long").schema
    assert jsonl.read_metadata(spark, path, schema).count() == 0
    for n in range(2):
        jsonl.append_metadata(spark.createDataFrame([("a", n)], schema), path)
    assert sorted(r.n for r in jsonl.read_metadata(spark, path, schema).collect()) == [0, 1]


def test_profiles_csv(spark, tmp_path):
    head = ",".join(PROFILE.names)
    good = write_lines(tmp_path / "ok.csv", [head, "m|t,m,t,0012,3,0.5,1.2,-0.7,0.1,0.2,0.3,0.4,0.5"])
    row = load_profiles(spark, good).first()
    assert row.problem_id == "0012" and row.n_failed_rollouts == 3 and row.dense_steer == 0.5
    with pytest.raises(ValueError, match="no rows"):
        load_profiles(spark, write_lines(tmp_path / "empty.csv", [head]))


def test_records_json(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text(json.dumps([{"pid": "p1", "feats": [1, 2, 3], "rescuers": ["retry"]}, {"pid": "p2", "feats": [0, 1, 0], "rescuers": []}], indent=1))
    assert {r.pid: r.feats for r in load_records(spark, str(path)).collect()} == {"p1": [1.0, 2.0, 3.0], "p2": [0.0, 1.0, 0.0]}


def test_missing_window_is_null(spark, tmp_path):
    path = str(tmp_path / "w")
    fc.save_windows(spark.createDataFrame([("d", "k1", 0, [1.0], None, [3])], LOGIT_WINDOW), path)
    keys = spark.createDataFrame([("k1",), ("k2",)], "key string")
    got = {r.key: (r.logits, r.spec_logits, r.prefix_ids) for r in fc.load_windows(spark, path, "d", keys).collect()}
    assert got == {"k1": ([1.0], None, [3]), "k2": (None, None, None)}


CASES = [
    # text, gold, exact, number, numeric
    ("the answer is 42", "42", True, "42", True),
    ("x \\boxed{1,234} y 7", "1234", False, "1234", True),
    ("\\boxed{a} then \\boxed{no digits} 5", "5", True, "5", True),
    ("\\boxed{3 or 4}", "4.0", False, "4", True),
    ("  12. ", " 12 ", True, "12.", True),
    ("none", "1", False, None, False),
    ("7", None, False, "7", False),
    ("word", "word", True, None, False),
    ("-5 and -6", "-6", True, "-6", True),
    ("tab\tgold\n", "\tgold\n", True, None, False),
    ("anything", "", True, None, False),
]


def test_correctness_checks(spark):
    df = spark.createDataFrame([(i, t, g) for i, (t, g, *_) in enumerate(CASES)], "i int, t string, g string")
    t, g = F.col("t"), F.col("g")
    out = df.select("i", an.exact_match(t, g).alias("e"), an.extract_number(t).alias("n"), an.numeric_answer(t, g).alias("q")).orderBy("i").collect()
    for r, (_, _, exact, number, numeric) in zip(out, CASES):
        assert (r.e, r.n, r.q) == (exact, number, numeric), CASES[r.i]


def test_regex_check(spark):
    rows = [("ans: 5 .", "5"), ("ans: 6", "5"), ("nothing", "5"), ("ans: 7", None)]
    df = spark.createDataFrame(rows, "t string, g string")
    t, g = F.col("t"), F.col("g")
    group = [r.v for r in df.select(an.regex(r"ans:(\s*\d)")(t, g).alias("v")).collect()]
    assert group == [True, False, False, True]
    whole = [r.v for r in df.select(an.regex(r"\d")(t, g).alias("v")).collect()]
    assert whole == [True, False, False, True]


def test_python_check_and_explicit_flags(spark):
    problems = spark.createDataFrame([("a", "4")], "problem_id string, answer string")
    rollouts = spark.createDataFrame(
        [("a", 0, "4", None), ("a", 1, "5", None), ("a", 2, "4", False), ("a", 3, "5", True), ("zz", 4, "4", None), ("a", 5, None, None)],
        "problem_id string, rollout_idx long, generated_text string, is_correct boolean",
    )
    check = an.python_check(lambda problem, text: problem.get("answer") == text)
    for fn in (check, an.exact_match):
        assert sorted(r.rollout_idx for r in sel.failures(rollouts, problems, fn).collect()) == [1, 2, 4, 5]
    assert sorted(r.rollout_idx for r in sel.failures(rollouts, problems).collect()) == [0, 1, 2, 4, 5]


def test_eligibility_needs_all_first_k_cached(spark):
    failed = spark.createDataFrame([("a", i) for i in (4, 9, 11)] + [("b", 1)], "pid string, rollout_idx long")
    cached = failed.where("NOT (pid = 'a' AND rollout_idx = 9)").withColumn(
        "Delta_path", F.when(F.col("pid") != "b", F.array(F.lit(0.0)))
    )
    assert {(r.pid, r.k) for r in sel.eligible_pairs(failed, cached, [1, 2, 3]).collect()} == {("a", 1)}
    firsts = sel.first_failures(failed, 2).collect()
    assert sorted((r.pid, r.rollout_idx, r.place) for r in firsts) == [("a", 4, 1), ("a", 9, 2), ("b", 1, 1)]


def test_rank_limit_runs_before_the_shuffle(spark):
    failed = spark.range(100).selectExpr("CAST(id % 3 AS STRING) AS pid", "id AS rollout_idx")
    plan = sel.first_failures(failed, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
