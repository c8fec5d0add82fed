"""Queries over sources, sinks, the feature cache and the input contract."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefork.catalog import inputs as I
from tracefork.catalog.registry import pick, pick_sql, query, r6, s6
from tracefork.functions import answers as an
from tracefork.operators import selection as sel
from tracefork.operators import token_features as tf
from tracefork.schemas import LOGIT_WINDOW, ROLLOUT_FILE, TRACE
from tracefork.session import durable, fresh_path
from tracefork.sources import feature_cache as fc
from tracefork.sources import jsonl

PROBLEM_COLS = ["problem_id", "prompt", "answer"]


@query("a1_a2_jsonl_round_trip", I.with_sql(*I.PROBLEMS, "SELECT problem_id, prompt, CASE WHEN CAST(problem_id AS BIGINT) % 4 <> 0 THEN answer END AS answer FROM pb"))
def a1(spark, sf):
    """Problems written as JSON lines (nulls kept) and read back."""
    path = fresh_path(spark, "problems")
    keep = F.col("problem_id").cast("bigint") % 4 != 0
    problems = I.problems(spark, sf).withColumn("answer", F.when(keep, F.col("answer")))
    jsonl.save_jsonl(problems, path)
    return jsonl.load_jsonl(spark, path, problems.schema)


def _aliased(name: str, value, n: int, of: int):
    """``value`` under this alias on every ``of``-th row, absent elsewhere."""
    return F.when(F.col("_row") % of == n, value).alias(name)


@query("a3_load_problems", I.with_sql(*I.PROBLEMS, "SELECT problem_id, prompt, answer FROM pb"))
def a3(spark, sf):
    """Ids and prompts spread over their aliases."""
    path = fresh_path(spark, "problems")
    p = I.problems(spark, sf).withColumn("_row", F.col("problem_id").cast("bigint"))
    pid, prompt = F.col("problem_id"), F.col("prompt")
    p.select(
        _aliased("problem_id", pid, 0, 3),
        _aliased("pid", pid, 1, 3),
        _aliased("id", pid, 2, 3),
        _aliased("prompt", prompt, 0, 3),
        _aliased("question", prompt, 1, 3),
        _aliased("input", prompt, 2, 3),
        "answer",
    ).write.json(path)
    return jsonl.load_problems(spark, path).select(*PROBLEM_COLS)


ROLLOUT_COLS = ["problem_id", "rollout_idx", "generated_text", "is_correct"]


@query("a4_load_rollouts", I.with_sql(*I.ROLLOUTS, f"SELECT {', '.join(ROLLOUT_COLS)} FROM ro"))
def a4(spark, sf):
    path = fresh_path(spark, "rollouts")
    r = I.rollouts(spark, sf).withColumn("_row", F.col("doc_id"))
    pid, idx, text = F.col("problem_id"), F.col("rollout_idx"), F.col("generated_text")
    r.select(
        _aliased("problem_id", pid, 0, 3),
        _aliased("pid", pid, 1, 3),
        _aliased("id", pid, 2, 3),
        _aliased("rollout_idx", idx, 0, 3),
        _aliased("rollout_id", idx, 1, 3),
        _aliased("sample_id", idx, 2, 3),
        F.when(F.col("doc_id") % 2 == 0, text).alias("generated_text"),
        F.when(F.col("doc_id") % 2 == 1, text).alias("answer"),
        "is_correct",
    ).write.json(path)
    return jsonl.load_rollouts(spark, path).select(*ROLLOUT_COLS)


@query(
    "a4_line_numbers",
    I.with_sql(
        *I.ROLLOUTS,
        """SELECT problem_id, CASE WHEN doc_id % 2 = 0 THEN doc_id + 100000000 ELSE row_number() OVER (ORDER BY doc_id) - 1 END AS rollout_idx,
        generated_text FROM ro""",
    ),
)
def a4_lines(spark, sf):
    """Every other row carries no index and takes its line number; files are in document order."""
    path = fresh_path(spark, "rollouts")
    (
        I.rollouts(spark, sf)
        .select("doc_id", "problem_id", "generated_text", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 100_000_000).alias("rollout_idx"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .drop("doc_id")
        .write.json(path)
    )
    return jsonl.load_rollouts(spark, path, ROLLOUT_FILE).select("problem_id", "rollout_idx", "generated_text")


# ---- feature cache ----

TASK, TAG = "arith", "base"


def store_cache(spark, sf, path):
    """Two batches in one cell; the second holds the even problems again, with Delta_path raised by one."""
    traces = durable(I.feature_cache(spark, sf))
    again = traces.where(F.col("pid").cast("bigint") % 2 == 0).withColumn(
        "Delta_path", F.transform("Delta_path", lambda x: x + 1)
    )
    fc.append_features(traces, path, TASK, TAG, batch=0)
    fc.append_features(again, path, TASK, TAG, batch=1)
    fc.append_features(traces, path, TASK, "other", batch=0)


def stored_cache(spark, sf):
    path = fresh_path(spark, "cache")
    store_cache(spark, sf, path)
    return fc.scan_cell(spark, path, TASK, TAG)


_SUMS = f"count(*) AS length, {s6('dp', 'round(avg(Delta_path), 3)')}, {s6('j', 'round(avg(J_approx), 3)')}"


def _sums(cell, *keys):
    means = {
        "dp": F.round(F.aggregate("Delta_path", F.lit(0.0), lambda a, x: a + x) / F.size("Delta_path"), 3),
        "j": F.round(F.aggregate("J_approx", F.lit(0.0), lambda a, x: a + x) / F.size("J_approx"), 3),
    }
    return cell.select(*keys, F.size("Delta_path").cast("bigint").alias("length"), *[c.alias(n) for n, c in means.items()])


@query(
    "a5_a7_cache_scan",
    I.with_sql(
        *I.CACHE,
        f"""SELECT pid, rollout_idx, CAST(0 AS BIGINT) AS shard, {_SUMS} FROM fc GROUP BY pid, rollout_idx
        UNION ALL SELECT pid, rollout_idx, 1, count(*), round(round(avg(Delta_path + 1), 3), 6) + 0, {s6('j', 'round(avg(J_approx), 3)').replace(' AS j', '')}
        FROM fc WHERE CAST(pid AS BIGINT) % 2 = 0 GROUP BY pid, rollout_idx""",
    ),
)
def a5(spark, sf):
    return _sums(stored_cache(spark, sf), *TRACE, "shard")


@query(
    "a8_last_shard_wins",
    I.with_sql(*I.CACHE, f"SELECT pid, rollout_idx, {_SUMS.replace('avg(Delta_path)', 'avg(Delta_path + (CASE WHEN CAST(pid AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END))')} FROM fc GROUP BY pid, rollout_idx"),
)
def a8(spark, sf):
    return _sums(fc.latest(stored_cache(spark, sf)), *TRACE)


@query("a8_point_lookup", I.with_sql(*I.CACHE, "SELECT pid, rollout_idx, count(*) AS length FROM fc WHERE pid = '2' AND rollout_idx = 1 GROUP BY pid, rollout_idx"))
def a8_one(spark, sf):
    hit = fc.lookup(stored_cache(spark, sf), "2", 1)
    return hit.select(*TRACE, F.size("J_approx").cast("bigint").alias("length"))


_ASKED = [("2", 1), ("0", 0), ("3", 0), ("nobody", 0)]


@query(
    "a8_indexed_lookup",
    I.with_sql(
        *I.CACHE,
        f"""SELECT pid, rollout_idx, CASE WHEN CAST(pid AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS shard,
        {_SUMS.replace('avg(Delta_path)', 'avg(Delta_path + (CASE WHEN CAST(pid AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END))')}
        FROM fc WHERE (pid, rollout_idx) IN (('2', 1), ('0', 0), ('3', 0)) GROUP BY pid, rollout_idx""",
    ),
)
def a8_indexed(spark, sf):
    """Several keys through the key index, of the appended cache and again of the compacted one."""
    path, index, target, second = (fresh_path(spark, f"indexed-{n}") for n in ("cache", "index", "compacted", "index2"))
    store_cache(spark, sf, path)
    fc.refresh_index(spark, path, "arith", "base", index)
    before = _sums(fc.indexed_lookup(spark, path, index, _ASKED), *TRACE, "shard")
    fc.compact(spark, path, "arith", "base", target)
    fc.refresh_index(spark, target, "arith", "base", second)
    after = _sums(fc.indexed_lookup(spark, target, second, _ASKED), *TRACE, "shard")
    return before.intersectAll(after)


@query("a9_done_keys", I.with_sql(*I.CACHE, "SELECT DISTINCT pid, rollout_idx FROM fc"))
def a9(spark, sf):
    return fc.done_keys(stored_cache(spark, sf))


@query(
    "a11_raw_capture",
    I.with_sql(
        *I.TOPK,
        """wd AS (SELECT pid, rollout_idx, model, max(n) AS k FROM (SELECT pid, rollout_idx, model, pos, count(*) AS n FROM tk GROUP BY ALL) GROUP BY ALL)""",
        """sl AS (SELECT *, row_number() OVER (PARTITION BY pid, rollout_idx, model, pos ORDER BY rank) - 1 AS slot FROM tk)""",
        """ps AS (SELECT DISTINCT pid, rollout_idx, model, pos FROM tk)""",
        f"""SELECT pid, rollout_idx, model, pos, CAST(g.i AS BIGINT) AS slot, coalesce(sl.token, -1) AS token_id, {s6('logprob', 'coalesce(sl.logprob, -1000)')}
        FROM ps JOIN wd USING (pid, rollout_idx, model) JOIN range(64) g(i) ON g.i < wd.k
        LEFT JOIN sl USING (pid, rollout_idx, model, pos) WHERE false
        UNION ALL SELECT ps.pid, ps.rollout_idx, ps.model, ps.pos, CAST(g.i AS BIGINT), coalesce(sl.token, -1), round(coalesce(sl.logprob, -1000), 6) + 0
        FROM ps JOIN wd ON wd.pid = ps.pid AND wd.rollout_idx = ps.rollout_idx AND wd.model = ps.model JOIN range(64) g(i) ON g.i < wd.k
        LEFT JOIN sl ON sl.pid = ps.pid AND sl.rollout_idx = ps.rollout_idx AND sl.model = ps.model AND sl.pos = ps.pos AND sl.slot = g.i""",
    ),
)
def a11(spark, sf):
    """The captured matrices, one row per cell of them."""
    rows = tf.capture_topk(I.topk(spark, sf)).select(
        *TRACE, "model", F.explode(F.arrays_zip("positions", "topk_logprobs", "topk_token_ids")).alias("r")
    )
    cells = rows.select(*TRACE, "model", "r.positions", F.posexplode(F.arrays_zip("r.topk_logprobs", "r.topk_token_ids")).alias("slot", "c"))
    return cells.select(
        *TRACE,
        "model",
        F.col("positions").alias("pos"),
        F.col("slot").cast("bigint").alias("slot"),
        F.col("c.topk_token_ids").alias("token_id"),
        r6("logprob", F.col("c.topk_logprobs")),
    )


@query(
    "a11_aligned_capture",
    I.with_sql(
        *I.TOPK,
        "tg AS (SELECT * FROM tk WHERE NOT (model = 'S' AND pos % 7 = 3) AND NOT (model = 'A' AND pos % 5 = 2))",
        """al AS (SELECT pid, rollout_idx, pos, row_number() OVER (PARTITION BY pid, rollout_idx ORDER BY pos) - 1 AS n
        FROM tg GROUP BY pid, rollout_idx, pos HAVING count(DISTINCT model) = 2)""",
        """sl AS (SELECT tg.*, n // 16 AS block, row_number() OVER (PARTITION BY pid, rollout_idx, model, pos ORDER BY rank) - 1 AS slot
        FROM tg JOIN al USING (pid, rollout_idx, pos))""",
        "wd AS (SELECT pid, rollout_idx, model, block, max(slot) + 1 AS k FROM sl GROUP BY ALL)",
        """SELECT sl.pid, sl.rollout_idx, sl.model, sl.pos, sl.slot, token AS token_id, round(CAST(CAST(logprob AS FLOAT) AS DOUBLE), 4) + 0 AS logprob FROM sl
        UNION ALL SELECT d.pid, d.rollout_idx, d.model, d.pos, CAST(g.i AS BIGINT), -1, -1000.0::DOUBLE
        FROM (SELECT pid, rollout_idx, model, pos, block, count(*) AS n FROM sl GROUP BY ALL) d
        JOIN wd ON wd.pid = d.pid AND wd.rollout_idx = d.rollout_idx AND wd.model = d.model AND wd.block = d.block
        JOIN range(64) g(i) ON g.i >= d.n AND g.i < wd.k""",
    ),
)
def a11_aligned(spark, sf):
    """Both models lack some positions; blocks of sixteen, written and read back, then one row per cell."""
    gaps = I.topk(spark, sf).where("NOT (model = 'S' AND pos % 7 = 3) AND NOT (model = 'A' AND pos % 5 = 2)")
    path = fresh_path(spark, "capture")
    fc.save_capture(tf.capture_blocks(gaps, rows=16), path, "arith", "base")
    cells = tf.capture_entries(fc.load_capture(spark, path, "arith", "base"))
    return cells.withColumn("logprob", F.round("logprob", 4))


@query(
    "a12_logit_windows",
    I.with_sql(
        *I.LOGITS,
        """SELECT pid || '_' || rollout_idx || '_' || t AS key, count(*) FILTER (t < 40) > 0 AS found,
        round(CAST(max(CAST(z_a AS FLOAT)) FILTER (t < 40) AS DOUBLE), 3) + 0 AS peak FROM zl GROUP BY pid, rollout_idx, t""",
    ),
)
def a12(spark, sf):
    """Windows stored for the first forty steps; later keys come back empty."""
    path = fresh_path(spark, "windows")
    key = F.concat_ws("_", "pid", F.col("rollout_idx").cast("string"), F.col("t").cast("string"))
    pairs = I.logit_pairs(spark, sf).withColumn("key", key)
    windows = pairs.where("t < 40").select(
        F.lit("page_hinkley").alias("detector_id"),
        "key",
        F.lit(0).alias("w_idx"),
        F.col("z_a").cast("array<float>").alias("logits"),
        F.col("z_s").cast("array<float>").alias("spec_logits"),
        F.array(F.col("x_t").cast("int")).alias("prefix_ids"),
    )
    fc.save_windows(windows.select(*LOGIT_WINDOW.names), path)
    back = fc.load_windows(spark, path, "page_hinkley", pairs.select("key"))
    peak = F.round(F.array_max("logits").cast("double"), 3)
    return back.select("key", F.col("logits").isNotNull().alias("found"), peak.alias("peak"))


@query("a13_metadata_log", I.with_sql(*I.PROBLEMS, "SELECT problem_id, answer, 'first' AS batch FROM pb UNION ALL SELECT problem_id, answer, 'second' FROM pb"))
def a13(spark, sf):
    path = fresh_path(spark, "metadata")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("problem_id", "answer", "batch")])
    for batch in ("first", "second"):
        jsonl.append_metadata(I.problems(spark, sf).select("problem_id", "answer", F.lit(batch).alias("batch")), path)
    return jsonl.read_metadata(spark, path, schema)


# ---- correctness and selection ----


def with_gold(spark, sf):
    return I.rollouts(spark, sf).join(I.problems(spark, sf).select("problem_id", "answer"), "problem_id", "left")


def _checked(name, sql, check):
    @query(name, I.with_sql(*I.ROLLOUTS, f"SELECT doc_id, {sql} AS ok FROM ro LEFT JOIN pb USING (problem_id)"))
    def run(spark, sf):
        return with_gold(spark, sf).select("doc_id", check(F.col("generated_text"), F.col("answer")).alias("ok"))


_checked("b1_exact_match", "coalesce(contains(generated_text, trim(pb.answer)), false)", an.exact_match)
_checked("b3_numeric_answer", I.numeric_sql("generated_text", "pb.answer"), an.numeric_answer)
_checked(
    "b4_regex_group",
    r"coalesce(regexp_matches(generated_text, 'total ([\d,]+)') AND (pb.answer IS NULL OR trim(regexp_extract(generated_text, 'total ([\d,]+)', 1)) = trim(pb.answer)), false)",
    an.regex(r"total ([\d,]+)"),
)
_checked(
    "b4_regex_match",
    r"coalesce(regexp_matches(generated_text, '\d,\d+') AND (pb.answer IS NULL OR trim(regexp_extract(generated_text, '\d,\d+')) = trim(pb.answer)), false)",
    an.regex(r"\d,\d+"),
)
_checked(
    "k1_python_check",
    "coalesce(contains(generated_text, pb.answer), false)",
    an.python_check(lambda problem, text: problem.get("answer") is not None and problem["answer"] in text),
)


@query("b2_extract_number", I.with_sql(*I.ROLLOUTS, f"SELECT doc_id, {I.number_sql('generated_text')} AS number FROM ro"))
def b2(spark, sf):
    return I.rollouts(spark, sf).select("doc_id", an.extract_number(F.col("generated_text")).alias("number"))


@query("b5_failures", I.with_sql(*I.MARKED, "SELECT doc_id, problem_id, rollout_idx FROM mk WHERE NOT ok"))
def b5(spark, sf):
    failed = sel.failures(I.rollouts(spark, sf), I.problems(spark, sf), an.numeric_answer)
    return failed.select("doc_id", "problem_id", "rollout_idx")


@query(
    "b5_last_of_repeated_problems",
    I.with_sql(
        *[
            part.replace("THEN '1,00' ELSE '' END ||", "AND item_id % 3 <> 0 THEN '1,00' ELSE '' END ||").replace(
                "CAST(item_id % 5 AS VARCHAR) AS answer", "CAST((item_id + CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END) % 5 AS VARCHAR) AS answer"
            )
            for part in I.MARKED
        ],
        "SELECT doc_id, problem_id, rollout_idx FROM mk WHERE NOT ok",
    ),
)
def b5_last(spark, sf):
    failed = sel.failures(I.rollouts(spark, sf), I.repeated_problems(spark, sf), an.numeric_answer)
    return failed.select("doc_id", "problem_id", "rollout_idx")


@query("b5_failures_unchecked", I.with_sql(*I.ROLLOUTS, "SELECT doc_id FROM ro WHERE NOT coalesce(is_correct, false)"))
def b5_plain(spark, sf):
    return sel.failures(I.rollouts(spark, sf), I.problems(spark, sf)).select("doc_id")


@query(
    "b6_normalised_keys",
    I.with_sql(
        *I.ROLLOUTS,
        "SELECT problem_id AS pid, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE rollout_idx END AS rollout_idx, CASE WHEN doc_id % 5 = 4 THEN '' ELSE generated_text END AS generated_text FROM ro",
    ),
)
def b6(spark, sf):
    """Keys under rotating aliases, empty ids passed over, index and text sometimes absent."""
    doc = F.col("doc_id")
    pid, idx, text = F.col("problem_id"), F.col("rollout_idx"), F.col("generated_text")
    raw = I.rollouts(spark, sf).select(
        F.when(doc % 2 == 0, F.lit("")).otherwise(pid).alias("pid"),
        F.when(doc % 2 == 0, pid).alias("problem_id"),
        F.when(doc % 4 == 0, idx).alias("rollout_id"),
        F.when(doc % 4 == 1, idx).alias("rollout_idx"),
        F.when(doc % 4 == 2, idx).alias("sample_id"),
        F.when(doc % 5 < 2, text).alias("generated_text"),
        F.when((doc % 5 >= 2) & (doc % 5 < 4), text).alias("answer"),
    )
    return sel.normalise_keys(raw)


TOKENS = [
    *I.ROLLOUTS,
    """tn AS (SELECT doc_id, problem_id AS pid, rollout_idx, list_transform(string_split(generated_text, ' '), lambda x: length(x)) AS ids FROM ro)""",
]


def tokenised(spark, sf):
    """Word lengths stand for token ids, offered under the three sources in turn; some are empty."""
    ids = F.transform(F.split("generated_text", " "), lambda w: F.length(w))
    doc = F.col("doc_id")
    none = F.array().cast("array<int>")
    return I.rollouts(spark, sf).select(
        "doc_id",
        F.col("problem_id").alias("pid"),
        "rollout_idx",
        F.when(doc % 3 == 0, ids).alias("output_ids"),
        F.when(doc % 3 == 0, none).when(doc % 3 == 1, ids).alias("token_ids"),
        F.when(doc % 15 == 2, none).when(doc % 15 != 5, ids).alias("encoded_ids"),
    )


@query(
    "b7_token_source",
    I.with_sql(*TOKENS, "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, CAST(list_sum(ids) AS BIGINT) AS total FROM tn WHERE doc_id % 15 NOT IN (2, 5)"),
)
def b7(spark, sf):
    total = F.aggregate("output_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sel.token_source(tokenised(spark, sf)).select(
        "doc_id", F.size("output_ids").cast("bigint").alias("n"), total.alias("total")
    )


@query("b8_with_prompt", I.with_sql(*I.ROLLOUTS, "SELECT doc_id FROM ro WHERE problem_id IN (SELECT problem_id FROM pb)"))
def b8(spark, sf):
    prompts = I.problems(spark, sf).select(F.col("problem_id").alias("pid"))
    return sel.with_prompt(I.rollouts(spark, sf).withColumnRenamed("problem_id", "pid"), prompts).select("doc_id")


@query("b9_resume", I.with_sql(*I.ROLLOUTS, "SELECT doc_id FROM ro WHERE NOT (CAST(problem_id AS BIGINT) < 20 AND rollout_idx % 2 = 0)"))
def b9(spark, sf):
    all_rollouts = I.rollouts(spark, sf).withColumnRenamed("problem_id", "pid")
    done = all_rollouts.where((F.col("pid").cast("bigint") < 20) & (F.col("rollout_idx") % 2 == 0))
    return sel.not_cached(all_rollouts, done).select("doc_id")


def sequences(spark, sf):
    return sel.build_sequences(I.sequences(spark, sf).drop("prompt_len"), I.prompts(spark, sf))


@query(
    "b10_sequences",
    I.with_sql(
        *I.LOGITS,
        """SELECT pid, rollout_idx, 3 + CAST(pid AS BIGINT) % 5 + t AS pos, x_t AS token FROM xt UNION ALL
        SELECT pid, rollout_idx, i - 1, CAST(pid AS BIGINT) * 7 + i FROM (SELECT DISTINCT pid, rollout_idx FROM xt), range(1, 9) g(i)
        WHERE i <= 3 + CAST(pid AS BIGINT) % 5""",
    ),
)
def b10(spark, sf):
    full = sequences(spark, sf).select(*TRACE, F.posexplode("full_ids").alias("pos", "token"))
    return full.select(*TRACE, F.col("pos").cast("bigint").alias("pos"), "token")


@query("b11_overlong", I.with_sql(*TOKENS, "SELECT count(*) FILTER (len(ids) <= 512) AS kept, count(*) FILTER (len(ids) > 512) AS dropped FROM tn"))
def b11(spark, sf):
    words = I.rollouts(spark, sf).select(F.split("generated_text", " ").alias("full_ids"))
    return sel.overlong_count(words, 512)


@query("b11_within_length", I.with_sql(*TOKENS, "SELECT doc_id FROM tn WHERE len(ids) <= 512"))
def b11_kept(spark, sf):
    words = I.rollouts(spark, sf).select("doc_id", F.split("generated_text", " ").alias("full_ids"))
    return sel.within_length(words, 512).select("doc_id")


def _aligned(name, raw, shift):
    @query(name, I.with_sql(*I.TOPK, f"pp AS (SELECT DISTINCT pid, rollout_idx, pos FROM tk WHERE pos % 11 <> 0)", f"SELECT xt.pid, xt.rollout_idx, xt.t, pp.pos, x_t FROM xt JOIN pp ON pp.pid = xt.pid AND pp.rollout_idx = xt.rollout_idx AND pp.pos = 3 + CAST(xt.pid AS BIGINT) % 5 + xt.t - {shift}"))
    def run(spark, sf):
        """Tokens beside the position of their distribution; positions missing from the table are skipped."""
        have = I.topk(spark, sf).where("pos % 11 <> 0").select(*TRACE, "pos")
        return sel.taken_tokens(sequences(spark, sf), raw).join(have, [*TRACE, "pos"], "left_semi")


_aligned("b12_prefill_alignment", False, 0)
_aligned("b12_raw_logit_alignment", True, 1)


@query(
    "b12_features_with_gaps",
    I.with_sql(*I.FEATURES, f"SELECT {pick_sql(['pid', 'rollout_idx', 't', 'pos'], ['J_approx', 'entropy'])} FROM ft WHERE pos % 11 <> 0 AND pos % 13 <> 0"),
)
def b12_gaps(spark, sf):
    """A position absent from one model's list, or from both, is left out."""
    topk = I.topk(spark, sf).where("pos % 11 <> 0 AND NOT (pos % 13 = 0 AND model = 'A')")
    out = tf.token_features(topk, I.taken(spark, sf), k_cov=I.K_COV, ranks="trusted")
    return pick(out, ["pid", "rollout_idx", "t", "pos"], ["J_approx", "entropy"])


@query(
    "b15_attempt_fanout",
    I.with_sql(
        *I.PROBLEMS,
        """cp AS (SELECT problem_id, answer, i AS rollout_idx, CASE i WHEN 0 THEN prompt || ' \\boxed{' || answer || '}' WHEN 1 THEN prompt ELSE 'so 1003' END AS generated_text
        FROM pb CROSS JOIN range(3) g(i))""",
        f"SELECT problem_id, rollout_idx, generated_text, {I.numeric_sql('generated_text', 'answer')} AS is_correct FROM cp",
    ),
)
def b15(spark, sf):
    boxed = F.concat("prompt", F.lit(" \\boxed{"), "answer", F.lit("}"))
    batches = I.problems(spark, sf).withColumn("completions", F.array(boxed, "prompt", F.lit("so 1003")))
    return sel.attempt_fanout(batches, an.numeric_answer)


@query("b16_write_order", I.with_sql(*I.CACHE, "SELECT pid, rollout_idx, count(*) AS length FROM fc GROUP BY pid, rollout_idx"))
def b16(spark, sf):
    """A cell written in problem order, a few rows per file, read back."""
    path = fresh_path(spark, "ordered")
    fc.append_features(I.feature_cache(spark, sf), path, TASK, TAG, rows_per_file=3)
    return fc.scan_cell(spark, path, TASK, TAG).select(*TRACE, F.size("J_approx").cast("bigint").alias("length"))
