"""Incremental feature extraction: only rollouts not cached yet, batch by batch, resumable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracefork.operators.selection import not_cached, taken_tokens
from tracefork.operators.token_features import COVERAGE_K, TEMPERATURE, assemble_traces, token_features
from tracefork.schemas import TRACE
from tracefork.session import durable
from tracefork.sources.feature_cache import append_features, done_keys, next_shard, path_exists, scan_cell


def extract_batch(
    sequences: DataFrame,
    topk: DataFrame,
    cache_path: str,
    task: str,
    model_tag: str,
    batch: int,
    first: bool = False,
    temperature: float = TEMPERATURE,
    k_cov: int = COVERAGE_K,
    ranks: str = "fill",
) -> None:
    """Features of the batch's new rollouts, appended to the cache.

    A batch that is run again finds its rollouts cached and adds nothing.
    """
    spark = sequences.sparkSession
    fresh = sequences.dropDuplicates(TRACE)
    if not first:
        fresh = not_cached(fresh, done_keys(scan_cell(spark, cache_path, task, model_tag)))
    wanted = topk.join(fresh.select(*TRACE), TRACE, "left_semi")
    traces = assemble_traces(token_features(wanted, taken_tokens(fresh), temperature, k_cov, ranks))
    append_features(traces, cache_path, task, model_tag, batch)


def extract_stream(
    sequences: DataFrame, topk: DataFrame, cache_path: str, task: str, model_tag: str, checkpoint: str, **options
) -> StreamingQuery:
    """Run ``extract_batch`` on every micro-batch of a stream of token sequences."""

    def each(batch: DataFrame, batch_id: int) -> None:
        # The cell's own numbers go on, also where a new checkpoint starts the batches at 0 again.
        shard = next_shard(batch.sparkSession, cache_path, task, model_tag)
        first = not path_exists(batch.sparkSession, cache_path)
        extract_batch(batch, topk, cache_path, task, model_tag, shard, first=first, **options)

    return (
        sequences.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def whole_places(topk: DataFrame, sequences: DataFrame, per_place: int | None) -> DataFrame:
    """How many places of each rollout have all their rows."""
    if per_place is None:
        return topk.groupBy(*TRACE).agg(F.count_distinct("model", "pos").alias("places"))
    taken = taken_tokens(sequences).select(*TRACE, "pos", F.col("x_t").alias("x"))
    found = topk.join(taken, [*TRACE, "pos"]).groupBy(*TRACE, "pos", "model")
    ranks = F.count_distinct(F.when(F.col("rank") <= per_place, F.col("rank")))
    full = found.agg(ranks.alias("ranks"), F.bool_or(F.col("token_id") == F.col("x")).alias("taken"))
    return full.where((F.col("ranks") >= per_place) & F.col("taken")).groupBy(*TRACE).agg(F.count("*").alias("places"))


def extract_topk_stream(
    topk: DataFrame,
    sequences: Callable[[SparkSession], DataFrame],
    cache_path: str,
    task: str,
    model_tag: str,
    pending_path: str,
    checkpoint: str,
    per_place: int | None = None,
    **options,
) -> StreamingQuery:
    """Features from a stream of top-K rows, each of which is read once, whatever their order.

    ``sequences`` gives the token sequences known when a batch starts. A rollout is extracted in the batch that brings
    the last of its places (a position in one of the two models); until then its rows wait in ``pending_path``, a folder
    for each batch, which the next batch reads instead of the source. Rollouts that never become whole stay listed there.
    The rows of one place are taken to come together; where they may not, ``per_place`` tells how many ranks a place has,
    and it is whole once it has these and its taken token. A batch that is run again finds its rollouts cached and writes
    the same pending rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, after = (f"{pending_path}/batch={i}" for i in (batch_id - 1, batch_id))
        if path_exists(spark, before):
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(before))
        first = not path_exists(spark, cache_path)
        cached = None if first else done_keys(scan_cell(spark, cache_path, task, model_tag))
        rows = durable(batch if cached is None else batch.join(cached, TRACE, "left_anti"))
        known = sequences(spark).dropDuplicates(TRACE)
        whole = durable(known.join(whole_places(rows, known, per_place), TRACE).where(F.col("places") >= 2 * F.size("output_ids")).drop("places"))
        if not whole.isEmpty():
            shard = next_shard(spark, cache_path, task, model_tag)
            extract_batch(whole, rows, cache_path, task, model_tag, shard, first=first, **options)
        rows.join(whole.select(*TRACE), TRACE, "left_anti").write.mode("overwrite").parquet(after)

    return (
        topk.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
