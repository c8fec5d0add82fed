"""The feature cache: one parquet table, one row per rollout, a partition per (task, model_tag)."""

from __future__ import annotations

from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefork.schemas import CACHE_ARRAYS, CAPTURE, FEATURE_CACHE, INDEX, LOGIT_WINDOW, TRACE

ROWS_PER_FILE = 500
#: Parquet settings of the cache: bloom filters on the problem.
BLOOM = {"parquet.bloom.filter.enabled#pid": "true", "parquet.bloom.filter.expected.ndv#pid": str(ROWS_PER_FILE)}


def with_cell(traces: DataFrame, task: str, model_tag: str) -> DataFrame:
    """Cast to the cache schema: float arrays beside their cell."""
    return traces.select(
        F.lit(task).alias("task"),
        F.lit(model_tag).alias("model_tag"),
        F.col("pid").cast("string").alias("pid"),
        F.col("rollout_idx").cast("bigint").alias("rollout_idx"),
        *[F.col(c).cast("array<float>").alias(c) for c in CACHE_ARRAYS if c in traces.columns],
        *[c for c in traces.columns if c not in (*TRACE, *CACHE_ARRAYS, "task", "model_tag")],
    )


def append_features(
    traces: DataFrame, path: str, task: str, model_tag: str, batch: int | None = None, rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Append a batch in problem order; ``shard`` tells batches apart for later lookups, and the last one wins.

    Without a number the batch takes one of its own after all that the cell holds, also while others append. Files are
    cut by key range and carry bloom filters of ``pid``, so a lookup skips those that can't hold its key.
    """
    if batch is None:
        batch = claim_shard(traces.sparkSession, path, task, model_tag)
    (
        with_cell(traces, task, model_tag)
        .withColumn("shard", F.lit(batch).cast("bigint"))
        .repartitionByRange("pid", "rollout_idx")
        .sortWithinPartitions("pid", "rollout_idx")
        .write.mode("append")
        .partitionBy("task", "model_tag")
        .option("maxRecordsPerFile", rows_per_file)
        .options(**BLOOM)
        .parquet(path)
    )


def claim_shard(spark: SparkSession, path: str, task: str, model_tag: str) -> int:
    """A shard number that no other writer gets: the first free one after the cell's last, reserved by a file that only
    one of several writers can create (its folder's name begins with an underscore, so no reader lists it)."""
    number = next_shard(spark, path, task, model_tag)
    while True:
        if created(spark, f"{path}/_shards/task={task}/model_tag={model_tag}/{number}"):
            return number
        number += 1


def created(spark: SparkSession, path: str) -> bool:
    """Whether this call made the file; of several at once one does."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # where Hadoop's own check and creation are two steps
        local = Path(target.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        try:
            local.touch(exist_ok=False)
        except FileExistsError:
            return False
        return True
    try:
        fs.create(target, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def next_shard(spark: SparkSession, path: str, task: str, model_tag: str) -> int:
    """One more than the largest shard of the cell; 0 for a new cache."""
    if not path_exists(spark, path):
        return 0
    last = scan_cell(spark, path, task, model_tag).agg(F.max("shard")).head()[0]
    return 0 if last is None else last + 1


def scan_cell(spark: SparkSession, path: str, task: str, model_tag: str) -> DataFrame:
    """All cached rollouts of a cell (partition pruned)."""
    return (
        spark.read.schema(FEATURE_CACHE)
        .parquet(path)
        .where((F.col("task") == task) & (F.col("model_tag") == model_tag))
    )


def places(cell: DataFrame) -> DataFrame:
    """Keys of a stored cell with the shard, file and place of each row; no array is read."""
    return cell.select(*TRACE, "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def latest(cell: DataFrame) -> DataFrame:
    """One row per rollout of a stored cell: where several batches hold it, the last one wins; of a batch that holds it
    twice, the later row.

    Winners are chosen among the keys alone, and only their rows are then kept: arrays are neither sorted nor grouped.
    """
    best = F.max(F.struct("shard", "file", "row")).alias("best")
    won = places(cell).groupBy(*TRACE).agg(best).select(*TRACE, F.col("best.file").alias("_file"), F.col("best.row").alias("_row"))
    stored = cell.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return stored.join(won, [*TRACE, "_file", "_row"], "left_semi").select(*cell.columns)


def refresh_index(spark: SparkSession, path: str, task: str, model_tag: str, index: str) -> None:
    """Bring the key index (key, shard, file, row) of a cell up to date: only files that it doesn't know are read.

    Entries of files that are gone stay and find nothing; an index of a compacted cache is begun anew.
    """
    cell = scan_cell(spark, path, task, model_tag)
    known = spark.read.schema(INDEX).parquet(index) if path_exists(spark, index) else spark.createDataFrame([], INDEX)
    seen = known.select("file").distinct()
    if path_exists(spark, index):
        names = {r.name for r in seen.select(F.substring_index("file", "/", -1).alias("name")).collect()}  # unique in a cache
        fresh = [f for f in cell.inputFiles() if f.rsplit("/", 1)[-1] not in names]
        if not fresh:
            return
        cell = spark.read.schema(FEATURE_CACHE).option("basePath", path).parquet(*fresh)
    rows = places(cell).repartitionByRange(*TRACE).sortWithinPartitions(*TRACE)
    rows.write.mode("append").options(**BLOOM).parquet(index)


def indexed_lookup(spark: SparkSession, path: str, index: str, keys: list[tuple[str, int]]) -> DataFrame:
    """The last rows of the asked keys, reading only the files that hold them. The driver sees one file name a key."""
    wanted = spark.createDataFrame(keys, "pid string, rollout_idx long")
    asked = spark.read.schema(INDEX).parquet(index).where(F.col("pid").isin(sorted({p for p, _ in keys})))
    best = F.max(F.struct("shard", "file", "row")).alias("best")
    won = asked.join(F.broadcast(wanted), TRACE, "left_semi").groupBy(*TRACE).agg(best).select(*TRACE, "best.file", "best.row")
    files = sorted({r.file for r in won.collect()})
    if not files:
        return spark.createDataFrame([], FEATURE_CACHE)
    hit = spark.read.schema(FEATURE_CACHE).option("basePath", path).parquet(*files).where(F.col("pid").isin(sorted({p for p, _ in keys})))
    placed = hit.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return placed.join(F.broadcast(won), [*TRACE, "file", "row"], "left_semi").select(*hit.columns)


def compact(spark: SparkSession, path: str, task: str, model_tag: str, target: str) -> None:
    """The last row of every rollout of a cell, in key order and with its shard, as a cell of the cache ``target``."""
    (
        latest(scan_cell(spark, path, task, model_tag))
        .repartitionByRange(*TRACE)
        .sortWithinPartitions(*TRACE)
        .write.mode("append")
        .partitionBy("task", "model_tag")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .options(**BLOOM)
        .parquet(target)
    )


def save_capture(blocks: DataFrame, path: str, task: str, model_tag: str) -> None:
    """Raw top-K blocks of a cell, beside the features."""
    cell = blocks.withColumns({"task": F.lit(task), "model_tag": F.lit(model_tag)})
    cell.write.mode("append").partitionBy("task", "model_tag").options(**BLOOM).parquet(path)


def load_capture(spark: SparkSession, path: str, task: str, model_tag: str) -> DataFrame:
    stored = spark.read.schema(CAPTURE).parquet(path)
    return stored.where((F.col("task") == task) & (F.col("model_tag") == model_tag)).drop("task", "model_tag")


def lookup(cell: DataFrame, pid: str, rollout_idx: int) -> DataFrame:
    """The cached row of one rollout, or none; the keys are pushed to the scan."""
    hits = cell.where((F.col("pid") == pid) & (F.col("rollout_idx") == rollout_idx))
    return latest(hits)


def done_keys(cell: DataFrame) -> DataFrame:
    """The cached (pid, rollout_idx), reading those two columns only."""
    return cell.select(*TRACE).distinct()


def is_cached(cell: DataFrame, pid: str, rollout_idx: int) -> bool:
    return not cell.where((F.col("pid") == pid) & (F.col("rollout_idx") == rollout_idx)).isEmpty()


def save_windows(windows: DataFrame, path: str) -> None:
    """Logit windows ``(detector_id, key, w_idx, logits, spec_logits, prefix_ids)``."""
    windows.write.mode("append").partitionBy("detector_id").parquet(path)


def load_windows(spark: SparkSession, path: str, detector_id: str, keys: DataFrame) -> DataFrame:
    """The windows of the wanted keys; a missing key comes back with nulls."""
    stored = spark.read.schema(LOGIT_WINDOW).parquet(path).where(F.col("detector_id") == detector_id)
    return keys.join(stored.drop("detector_id"), "key", "left")
