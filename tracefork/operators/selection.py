"""Choosing and shaping rollouts: failures, keys, token sequences, eligibility, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefork.functions.answers import CorrectnessColumn
from tracefork.plans.skew import hot_join
from tracefork.schemas import TRACE


#: Number of the line that a row was read from.
LINE = "line"


def _present(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key. Of repeated keys the row with the largest ``line`` stays, where the table has that column, as the
    last line of a file would. Else the largest row stays: a table has no last row, and this choice is the same in every
    run."""
    first = [c for c in df.columns if c == LINE]
    rest = first + [c for c in df.columns if c not in (*keys, LINE)]
    best = F.max(F.struct(*rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best").getField(c).alias(c) for c in rest if c != LINE])


def mark_correct(rollouts: DataFrame, problems: DataFrame, check: CorrectnessColumn | None) -> DataFrame:
    """Add ``ok``: an explicit non-null flag wins, then the check, else not correct.

    A rollout whose problem is missing is checked against a null gold answer. Salted, so a problem with
    a large share of the rollouts is spread; Spark broadcasts the problems when their size allows it. Of problems that
    repeat an id, the last line counts for every kind of check.
    """
    if check is None:
        return rollouts.withColumn("ok", F.coalesce("is_correct", F.lit(False)))
    whole = getattr(check, "whole_problem", False)  # such a check reads the problem as JSON
    gold = F.to_json(F.struct(*[c for c in problems.columns if c != LINE])) if whole else F.col("answer")
    line = [c for c in problems.columns if c == LINE]
    gold = one_per_key(problems.select("problem_id", gold.alias("gold"), *line), ["problem_id"])
    return (
        hot_join(rollouts, gold, ["problem_id"], ["rollout_idx"], "left")
        .withColumn(
            "ok",
            F.when(F.col("is_correct").isNotNull(), F.col("is_correct")).otherwise(
                check(F.coalesce("generated_text", F.lit("")), F.col("gold"))
            ),
        )
        .drop("gold")
    )


def failures(rollouts: DataFrame, problems: DataFrame, check: CorrectnessColumn | None = None) -> DataFrame:
    return mark_correct(rollouts, problems, check).where(~F.col("ok")).drop("ok")


def normalise_keys(rollouts: DataFrame) -> DataFrame:
    """Extraction keys: first non-empty id alias, first index alias, text or answer, in the order of the loader."""
    ids = [F.nullif(c.cast("string"), F.lit("")) for c in _present(rollouts, ["problem_id", "pid", "id"])]
    idx = _present(rollouts, ["rollout_idx", "rollout_id", "sample_id"])
    text = _present(rollouts, ["generated_text", "answer"])
    return rollouts.select(
        F.coalesce(*ids, F.lit("")).alias("pid"),
        F.coalesce(*[c.cast("bigint") for c in idx], F.lit(0)).alias("rollout_idx"),
        F.coalesce(*text, F.lit("")).alias("generated_text"),
        *_present(rollouts, ["output_ids", "token_ids", "encoded_ids"]),
    )


def token_source(rollouts: DataFrame) -> DataFrame:
    """``output_ids`` over ``token_ids`` over ``encoded_ids``; rows without tokens are dropped."""
    sources = _present(rollouts, ["output_ids", "token_ids", "encoded_ids"])
    ids = F.coalesce(*sources)
    others = [c for c in rollouts.columns if c not in ("output_ids", "token_ids", "encoded_ids")]
    return rollouts.select(*others, ids.alias("output_ids")).where(F.size("output_ids") > 0)


def with_prompt(rollouts: DataFrame, prompts: DataFrame) -> DataFrame:
    """Keep rollouts whose problem has a prompt."""
    return hot_join(rollouts, prompts.select("pid"), ["pid"], ["rollout_idx"], "left_semi")


def not_cached(rollouts: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Resume: drop the (pid, rollout_idx) already in the cache."""
    return rollouts if force else rollouts.join(done.select(*TRACE), TRACE, "left_anti")


def build_sequences(rollouts: DataFrame, prompts: DataFrame) -> DataFrame:
    """``full_ids`` = prompt then output, with ``prompt_len``."""
    one = one_per_key(prompts.select("pid", "prompt_ids"), ["pid"])
    return hot_join(rollouts, one, ["pid"], ["rollout_idx"]).select(
        *TRACE,
        "output_ids",
        F.size("prompt_ids").cast("bigint").alias("prompt_len"),
        F.concat("prompt_ids", "output_ids").alias("full_ids"),
    )


def within_length(sequences: DataFrame, max_len: int, length: Column | None = None) -> DataFrame:
    size = F.size("full_ids") if length is None else length
    return sequences.where(size <= max_len)


def overlong_count(sequences: DataFrame, max_len: int, length: Column | None = None) -> DataFrame:
    size = F.size("full_ids") if length is None else length
    return sequences.agg(
        F.count_if(size <= max_len).alias("kept"), F.count_if(size > max_len).alias("dropped")
    )


def taken_tokens(sequences: DataFrame, raw_logits: bool = False) -> DataFrame:
    """One row per generated token with the position of the distribution that produced it.

    A prefill list holds token ``i`` at ``prompt_len + i``; raw logits rows are one earlier.
    """
    shift = -1 if raw_logits else 0
    return sequences.select(
        *TRACE, "prompt_len", F.posexplode("output_ids").alias("i", "x_t")
    ).select(
        *TRACE,
        F.col("i").cast("bigint").alias("t"),
        (F.col("prompt_len") + F.col("i") + shift).cast("bigint").alias("pos"),
        F.col("x_t").cast("bigint").alias("x_t"),
    )


def first_failures(failed: DataFrame, k: int) -> DataFrame:
    """First ``k`` failures per problem by index, with their 1-based place.

    The rank filter is pushed below the shuffle, so a hot problem sends at most ``k`` rows per task.
    """
    w = W.partitionBy("pid").orderBy("rollout_idx")
    ranked = failed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return ranked.withColumn("place", F.col("place").cast("bigint"))


def eligible_pairs(
    failed: DataFrame, cached: DataFrame, k_values: Sequence[int], prompts: DataFrame | None = None
) -> DataFrame:
    """(pid, k) whose first ``k`` failures are all cached (and, given prompts, have one)."""
    return (
        background_members(failed, cached, k_values, prompts)
        .groupBy("pid", "k")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= F.col("k"))
        .select("pid", "k")
    )


def background_members(
    failed: DataFrame, cached: DataFrame, k_values: Sequence[int], prompts: DataFrame | None = None
) -> DataFrame:
    """(pid, rollout_idx, place, k) for every cached one of the first ``k`` failures."""
    ranked = first_failures(failed.select(*TRACE), max(k_values))
    if prompts is not None:
        ranked = with_prompt(ranked, prompts)
    usable = cached.where(F.col("Delta_path").isNotNull()) if "Delta_path" in cached.columns else cached
    ks = F.array(*[F.lit(k).cast("bigint") for k in sorted(set(k_values))])
    return (
        ranked.join(usable.select(*TRACE), TRACE, "left_semi")
        .withColumn("k", F.explode(ks))
        .where(F.col("place") <= F.col("k"))
    )


def attempt_fanout(batches: DataFrame, check: CorrectnessColumn) -> DataFrame:
    """One row per completion of a problem, numbered and marked correct."""
    return batches.select(
        "problem_id", "answer", F.posexplode("completions").alias("i", "generated_text")
    ).select(
        "problem_id",
        F.col("i").cast("bigint").alias("rollout_idx"),
        "generated_text",
        check(F.col("generated_text"), F.col("answer")).alias("is_correct"),
    )


def failure_counts(marked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Failed and total rollouts per key, or overall."""
    return marked.groupBy(*keys).agg(F.count_if(~F.col("ok")).alias("n_failed"), F.count("*").alias("n_total"))
