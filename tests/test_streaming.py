"""Streams equal their batch twins: shuffled input, repeated steps, several micro-batches."""

import random

import pytest

from tracefork.functions.answers import numeric_answer
from tracefork.operators import background as bg
from tracefork.plans.failed_trace import TraceConfig, cache_features, plan_repair, select_sequences
from tracefork.schemas import CACHE_ARRAYS, TOPK
from tracefork.sources import feature_cache as fc
from tracefork.streaming.incremental import extract_stream, extract_topk_stream
from tracefork.streaming.lifetime import Lifetime, write_events
from tracefork.streaming.ordering import StepBuffer
from tracefork.streaming.page_hinkley import PageHinkley, detect_events
from tracefork.streaming.scan_statistic import scan_events, scan_stream

STEP = "pid string, rollout_idx long, t long, d_t double"
SCORED = "pid string, rollout_idx long, t long, J_t double, tau_t string, lambda_J double"


def file_stream(spark, path, batches, schema):
    """One file per batch, read one per micro-batch in the order written."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return (
        spark.readStream.schema(spark.createDataFrame([], schema).schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(str(path))
    )


def collect_stream(stream, tmp_path, name):
    q = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / name))
        .option("checkpointLocation", str(tmp_path / f"{name}-cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()


def scatter(rows, n, seed):
    rng = random.Random(seed)
    rows = rows + rng.sample(rows, len(rows) // 10)
    rng.shuffle(rows)
    return [rows[i::n] for i in range(n)]


def test_page_hinkley_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"p{i}", r, t, rng.gauss(0.03 * t * (i % 2), 1.0)) for i in range(6) for r in range(2) for t in range(60)]
    detector = PageHinkley(lam=8.0)
    batch = detector.batch(spark.createDataFrame(rows, STEP)).collect()
    stream = detector.stream(file_stream(spark, tmp_path / "in", scatter(rows, 3, 1), STEP))
    got = collect_stream(stream, tmp_path, "out")
    assert 0 < len(batch) < 12
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_scan_stream_equals_batch(spark, tmp_path):
    rng = random.Random(10)
    rows = [
        (f"p{i}", 0, t, rng.random(), rng.choice(["path", "cov"]), 2.2 + 0.2 * (i % 3)) for i in range(9) for t in range(25)
    ]
    scored = spark.createDataFrame(rows, SCORED).selectExpr(
        "*", "0D AS Z_path", "0D AS Z_cov", "true AS entropy_sensitive", "0D AS pS_on_set", "0D AS pA_on_set"
    )
    batch = {(r.pid, r.t_hat, r.tau_hat) for r in bg.online_replay(scored, w=3, warmup=5).collect()}
    stream = scan_stream(file_stream(spark, tmp_path / "in", scatter(rows, 3, 2), SCORED), w=3, warmup=5)
    got = collect_stream(stream, tmp_path, "out")
    assert {(r.pid, r.t_hat, r.tau_hat) for r in got} == batch and batch
    assert len(got) == len(batch)


def test_buffer_waits_for_the_gap_and_drops_repeats():
    import pandas as pd

    def frame(*ts):
        return pd.DataFrame({"t": ts, "x": [float(t) for t in ts]})

    buffer = StepBuffer(0, {})
    assert [t for t, _ in buffer.take([frame(2, 1)], ["x"])] == []
    assert [t for t, _ in buffer.take([frame(0), frame(2, 0, 4)], ["x"])] == [0, 1, 2]
    assert list(buffer.waiting) == [4]
    held = StepBuffer(0, {}, held=1)
    assert [t for t, _ in held.take([frame(0, 1, 2)], ["x"])] == [0, 1]


@pytest.mark.parametrize("held", [0, 1])
def test_buffer_is_bounded_and_tells_what_it_drops(held):
    import pandas as pd

    rng = random.Random(13)
    for _ in range(60):
        steps = [t for t in range(40) if rng.random() > 0.1]
        rng.shuffle(steps)
        buffer, done, spilled = StepBuffer(0, {}, held, most=4), [], []
        for at in range(0, len(steps), 5):
            frame = pd.DataFrame({"t": steps[at : at + 5], "x": 0.0})
            done += [t for t, _ in buffer.take([frame], ["x"])]
            spilled += [t for t, _ in buffer.spilled()]
            assert len(buffer.waiting) <= 4 + held
        assert done == list(range(len(done)))
        left = [t for t, _ in buffer.left()]
        held_back = set(range(len(done), buffer.next_step))
        assert len(held_back) <= held
        assert sorted([*done, *held_back, *spilled, *left]) == sorted(steps)


TIMED = "pid string, rollout_idx long, t long, d_t double, s long, last boolean"


def timed_stream(spark, path, batches, schema=TIMED):
    stream = file_stream(spark, path, batches, schema)
    return stream.selectExpr("*", "timestamp_seconds(s + 1000) AS at").withWatermark("at", "10 seconds")


def run_events(events, tmp_path):
    q = write_events(events, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    rows = events.sparkSession.read.schema(events.schema).parquet(str(tmp_path / "out")).collect()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return sorted((r.pid, r.kind, r.t) for r in rows if r.pid != "clock"), kept


def clock(*seconds):
    return [[("clock", 0, s, 0.0, s, False)] for s in seconds]


def climbing(pid, n, start=0, last=False):
    """A trace that fires soon after step 20."""
    return [(pid, 0, t, 0.1 * (t % 2) if t < 20 else 9.0, start + t, last and t == n - 1) for t in range(n)]


def test_an_ended_trace_does_not_fire_again_and_is_forgotten(spark, tmp_path):
    life = Lifetime(event_time="at", idle_ms=30_000, forget_ms=200_000)
    batches = [
        climbing("a", 25) + climbing("b", 15),  # a fires, b stops short of it
        *clock(100, 101),  # both have been silent for long enough
        climbing("a", 40, start=105) + climbing("b", 40, start=105),  # both come again: too late
        *clock(2_000, 2_001, 2_002),  # and are forgotten
    ]
    got, kept = run_events(detect_events(timed_stream(spark, tmp_path / "in", batches), lam=8.0, life=life), tmp_path)
    assert [x for x in got if x[1] == "fire"] == [("a", "fire", 20)]
    late = {(p, t) for p, kind, t in got if kind == "late"}
    assert {("b", t) for t in range(15, 40)} <= late and not {t for p, t in late if p == "b" and t < 15}
    assert max(kept) >= 3 and kept[-1] <= 1  # the clock's own trace at most


def test_a_marked_last_step_ends_a_trace(spark, tmp_path):
    steps = climbing("a", 15, last=True)
    more = [("a", 0, t, 9.0, t, False) for t in range(12, 30)]
    got, _ = run_events(detect_events(timed_stream(spark, tmp_path / "in", [steps[8:], steps[:8], more]), lam=8.0, life=Lifetime(last="last")), tmp_path)
    assert got == [("a", "late", t) for t in range(15, 30)]


def test_steps_behind_a_gap_are_told(spark, tmp_path):
    life = Lifetime(event_time="at", idle_ms=30_000, max_waiting=4)
    steps = [x for x in climbing("a", 30) if x[2] != 12]
    batches = [steps[:14], steps[14:], *clock(200, 201, 202)]
    got, _ = run_events(detect_events(timed_stream(spark, tmp_path / "in", batches), lam=8.0, life=life), tmp_path)
    assert got == [("a", "unplaced", t) for t in range(13, 30)]


def test_scan_state_ends_too(spark, tmp_path):
    life = Lifetime(event_time="at", idle_ms=30_000)
    rows = [("a", 0, t, 0.5, "path", 9.0, t) for t in range(12)] + [("a", 0, 14, 0.5, "cov", 9.0, 14)]
    ticks = [[("clock", 0, s, 0.0, "path", 9.0, s)] for s in (200, 201, 900, 901, 902)]
    schema = SCORED + ", s long"
    events = scan_events(timed_stream(spark, tmp_path / "in", [rows, *ticks], schema), w=2, warmup=3, life=life)
    got, kept = run_events(events, tmp_path)
    assert got == [("a", "unplaced", 14)]  # step 11 was only held back
    assert kept[-1] <= 1


# ---- the two stages end to end ----


@pytest.fixture()
def world(spark):
    rng = random.Random(11)
    problems = spark.createDataFrame([("q1", "two", "2"), ("q2", "three", "3"), ("q3", "none", "9")], "problem_id string, prompt string, answer string")
    prompts = spark.createDataFrame([("q1", [1, 2, 3]), ("q2", [4])], "pid string, prompt_ids array<int>")
    rollouts, topk = [], []
    for pid, plen in (("q1", 3), ("q2", 1), ("q3", 2)):
        for idx in range(4):
            ids = [rng.randrange(8) for _ in range(30 + idx)]
            text = "it is 2" if pid == "q1" and idx == 0 else "so 77"
            rollouts.append((pid, idx, text, None, ids if idx != 3 or pid != "q2" else []))
            for i in range(len(ids)):
                for model in "SA":
                    lps = sorted((-rng.random() * 4 for _ in range(8)), reverse=True)
                    topk += [(pid, idx, plen + i, model, t, lp, n + 1) for n, (t, lp) in enumerate(zip(rng.sample(range(8), 8), lps))]
    return (
        problems,
        prompts,
        spark.createDataFrame(rollouts, "problem_id string, rollout_idx long, generated_text string, is_correct boolean, output_ids array<int>"),
        spark.createDataFrame(topk, TOPK),
    )


def test_two_stages(spark, tmp_path, world):
    problems, prompts, rollouts, topk = world
    config = TraceConfig("arith", "tiny", str(tmp_path / "cache"), k_cov=3, max_model_len=34)
    chosen = select_sequences(problems, rollouts, prompts, numeric_answer, config)
    keys = {(r.pid, r.rollout_idx) for r in chosen.collect()}
    # q1/0 is right, q3 has no prompt, q2/3 has no tokens, q1/2 and q1/3 are too long
    assert keys == {("q1", 1), ("q2", 0), ("q2", 1), ("q2", 2)}
    cache_features(chosen, topk, config)
    cell = fc.scan_cell(spark, config.cache_path, "arith", "tiny")
    assert {(r.pid, r.rollout_idx) for r in fc.done_keys(cell).collect()} == keys
    again = select_sequences(problems, rollouts, prompts, numeric_answer, config, done=fc.done_keys(cell))
    assert again.count() == 0
    failed = chosen.select("pid", "rollout_idx")
    plan, backgrounds = plan_repair(failed, prompts, config, k_values=[1, 3])
    assert {(r.pid, r.k) for r in backgrounds.collect()} == {("q1", 1), ("q2", 1), ("q2", 3)}
    assert plan.count() == 3 * 7


def test_incremental_extraction_is_resumable(spark, tmp_path, world):
    _, prompts, rollouts, topk = world
    seq = rollouts.where("size(output_ids) > 0").selectExpr("problem_id AS pid", "rollout_idx", "output_ids")
    rows = seq.join(prompts, "pid").selectExpr("pid", "rollout_idx", "output_ids", "CAST(size(prompt_ids) AS BIGINT) AS prompt_len").collect()
    schema = "pid string, rollout_idx long, output_ids array<int>, prompt_len long"
    cache = str(tmp_path / "cache")
    first, second = rows[:4], rows[2:]  # two rollouts come twice
    for i, part in enumerate((first, second)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
        extract_stream(stream, topk, cache, "a", "b", str(tmp_path / "cp"), k_cov=3).awaitTermination()
    cell = fc.scan_cell(spark, cache, "a", "b").collect()
    assert sorted((r.pid, r.rollout_idx) for r in cell) == sorted((r.pid, r.rollout_idx) for r in rows)
    assert all(len(r.J_approx) > 0 for r in cell)


def test_topk_rows_are_read_once_in_any_order(spark, tmp_path, world):
    _, prompts, rollouts, topk = world
    seq = rollouts.where("size(output_ids) > 0").selectExpr("problem_id AS pid", "rollout_idx", "output_ids")
    seq = seq.join(prompts, "pid").selectExpr("pid", "rollout_idx", "output_ids", "CAST(size(prompt_ids) AS BIGINT) AS prompt_len")
    wanted = topk.join(seq.select("pid", "rollout_idx"), ["pid", "rollout_idx"], "left_semi").collect()
    random.Random(3).shuffle(wanted)
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")

    def extracted(cache, batches, name):
        stream = file_stream(spark, tmp_path / f"in-{name}", batches, TOPK)
        q = extract_topk_stream(stream, lambda _: seq, cache, "a", "b", str(tmp_path / f"pending-{name}"), str(tmp_path / f"cp-{name}"), per_place=8, k_cov=3)
        q.awaitTermination()
        assert sum(p["numInputRows"] for p in q.recentProgress) == len(wanted)
        rows = fc.scan_cell(spark, cache, "a", "b").collect()
        assert len({(r.pid, r.rollout_idx) for r in rows}) == len(rows)
        return {(r.pid, r.rollout_idx, name): r[name] for r in rows for name in CACHE_ARRAYS}

    n = len(wanted)
    one = extracted(whole, [wanted], "one")
    two = extracted(cut, [wanted[: n // 3], wanted[n // 3 : n - 5], wanted[n - 5 :]], "cut")
    assert two.keys() == one.keys()
    assert [(k, a, b) for k, v in one.items() for a, b in zip(v, two[k], strict=True) if a != b and a != pytest.approx(b, rel=1e-4, abs=1e-4)] == []
    assert len(one) == seq.count() * len(CACHE_ARRAYS)
    left = spark.read.parquet(str(tmp_path / "pending-cut" / "batch=2"))
    assert left.count() == 0
    short = str(tmp_path / "short")
    stream = file_stream(spark, tmp_path / "in-short", [wanted[: n - 5]], TOPK)
    extract_topk_stream(stream, lambda _: seq, short, "a", "b", str(tmp_path / "pending-short"), str(tmp_path / "cp-short"), per_place=8, k_cov=3).awaitTermination()
    waiting = spark.read.parquet(str(tmp_path / "pending-short" / "batch=0")).select("pid", "rollout_idx").distinct().count()
    assert waiting >= 1 and fc.scan_cell(spark, short, "a", "b").count() == seq.count() - waiting
