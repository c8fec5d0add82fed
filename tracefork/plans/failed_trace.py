"""The two stages end to end: cache features of failed rollouts, then plan the repair sweep.

Decoding is external: log-probability tables come in, request plans go out, outcome tables come back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tracefork.functions.answers import CorrectnessColumn
from tracefork.operators import background as bg
from tracefork.operators import selection as sel
from tracefork.operators import sweep
from tracefork.operators.token_features import COVERAGE_K, TEMPERATURE, assemble_traces, token_features
from tracefork.sources import feature_cache as fc


@dataclass(frozen=True)
class TraceConfig:
    task: str
    model_tag: str
    cache_path: str
    temperature: float = TEMPERATURE
    k_cov: int = COVERAGE_K
    w: int = 1
    warmup: int = bg.WARMUP
    max_model_len: int | None = None
    max_new_tokens: int = 1024
    seed: int = 42
    ranks: str = "fill"


def select_sequences(
    problems: DataFrame,
    rollouts: DataFrame,
    prompts: DataFrame,
    check: CorrectnessColumn | None,
    config: TraceConfig,
    done: DataFrame | None = None,
) -> DataFrame:
    """Failed rollouts with a prompt and tokens, not cached yet, within the length limit."""
    failed = sel.token_source(sel.normalise_keys(sel.failures(rollouts, problems, check)))
    failed = sel.with_prompt(failed.where("pid <> ''"), prompts)
    if done is not None:
        failed = sel.not_cached(failed, done)
    sequences = sel.build_sequences(failed, prompts)
    if config.max_model_len is not None:
        sequences = sel.within_length(sequences, config.max_model_len)
    return sequences


def cache_features(sequences: DataFrame, topk: DataFrame, config: TraceConfig, batch: int | None = None) -> None:
    """Stage 1: per-token features of the selected rollouts, appended to the cache."""
    features = token_features(topk, sel.taken_tokens(sequences), config.temperature, config.k_cov, config.ranks)
    fc.append_features(assemble_traces(features), config.cache_path, config.task, config.model_tag, batch)


def plan_repair(
    failed: DataFrame,
    prompts: DataFrame,
    config: TraceConfig,
    operators: Sequence[str] = ("geo", "rand", "dense", "local_temp"),
    k_values: Sequence[int] = (1,),
) -> tuple[DataFrame, DataFrame]:
    """Stage 2: (request plan, backgrounds) of every eligible (pid, k)."""
    cache = fc.latest(fc.scan_cell(failed.sparkSession, config.cache_path, config.task, config.model_tag))
    backgrounds = bg.backgrounds_for(failed, cache, k_values, config.w, prompts=prompts)
    plan = sweep.request_plan(
        backgrounds.select("pid", "k"), operators, config.seed, config.warmup, config.max_new_tokens
    )
    return plan, backgrounds


def fold_outcomes(attempts: DataFrame, fires: DataFrame) -> DataFrame:
    """Outcome table with fire events read back; the input of every sweep report."""
    return sweep.read_back_fires(attempts, fires)
