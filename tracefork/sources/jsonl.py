"""JSON-lines problems and rollouts: explicit schemas, key aliases resolved at load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefork.schemas import PROBLEM_FILE, ROLLOUT_FILE


def load_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped, bad JSON fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def save_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, null fields written as null."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_metadata(df: DataFrame, path: str) -> None:
    save_jsonl(df, path, mode="append")


def read_metadata(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All appended records; an empty frame when nothing has been written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return load_jsonl(spark, path, schema)


def _first(df: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def normalise_problems(raw: DataFrame) -> DataFrame:
    """``problem_id`` and ``prompt`` from their aliases; other columns pass through."""
    ids = [c.cast("string") for c in _first(raw, ["problem_id", "pid", "id"])]
    prompts = _first(raw, ["prompt", "question", "input"])
    rest = [c for c in raw.columns if c not in ("problem_id", "prompt")]
    return raw.select(
        F.coalesce(*ids, F.lit("")).alias("problem_id"), F.coalesce(*prompts, F.lit("")).alias("prompt"), *rest
    )


def normalise_rollouts(raw: DataFrame, line_number: Column | None = None) -> DataFrame:
    """``problem_id, rollout_idx, generated_text, is_correct`` from their aliases; others pass through.

    A null ``is_correct`` means unknown. Rows without an index take their line number.
    """
    ids = [c.cast("string") for c in _first(raw, ["problem_id", "pid", "id"])]
    idx = [c.cast("bigint") for c in _first(raw, ["rollout_idx", "rollout_id", "sample_id"])]
    if line_number is not None:
        idx.append(line_number)
    text = _first(raw, ["generated_text", "answer"])
    own = ("problem_id", "rollout_idx", "generated_text", "is_correct", "_line")
    rest = [c for c in raw.columns if c not in own]
    correct = F.col("is_correct").cast("boolean") if "is_correct" in raw.columns else F.lit(None).cast("boolean")
    return raw.select(
        F.coalesce(*ids, F.lit("")).alias("problem_id"),
        F.coalesce(*idx).alias("rollout_idx"),
        F.coalesce(*text).alias("generated_text"),
        correct.alias("is_correct"),
        *rest,
    )


def parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The listed keys of each line as columns, and all others in ``extra``, a map of their JSON texts.

    Flags are read as written, so that 0 and 1 serve as well as false and true. Bad JSON fails the read.
    """
    loose = T.StructType([T.StructField(f.name, T.StringType() if f.dataType == T.BooleanType() else f.dataType) for f in schema])
    options = {"mode": "FAILFAST"}
    names = [F.lit(f.name) for f in schema]
    whole = lines.withColumn("_r", F.from_json("value", loose, options))
    others = F.map_filter(F.from_json("value", "map<string,string>", options), lambda k, _: ~F.array_contains(F.array(*names), k))
    return whole.select(*[_typed(f) for f in schema], others.alias("extra"), *[c for c in lines.columns if c != "value"])


def _typed(field: T.StructField) -> Column:
    value = F.col("_r").getField(field.name)
    if field.dataType == T.BooleanType():
        value = F.when(F.lower(value).isin("true", "false"), F.lower(value) == "true").otherwise(value.cast("double") != 0)
    return value.alias(field.name)


def load_problems(spark: SparkSession, path: str, schema: T.StructType = PROBLEM_FILE) -> DataFrame:
    """Problems from JSON lines, with their number (``line``) and text (``raw``); keys that the schema doesn't list are
    in ``extra`` too, as text."""
    lines = numbered_lines(spark, path).withColumn("raw", F.col("value"))
    return normalise_problems(parsed(lines, schema))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their 0-based number, files in name order.

    Each file split counts its own lines; the split offsets are a running sum over one row per split.
    The numbers depend on the files and their splits only.
    """
    lines = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
        .where(F.length(F.trim("value")) > 0)
        .withColumn("m", F.monotonically_increasing_id())
    )
    before = W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)
    splits = (
        lines.groupBy("f", "b")
        .agg(F.count("*").alias("n"), F.min("m").alias("m0"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select("f", "b", "m0", "start")
    )
    return lines.join(splits, ["f", "b"]).select(
        "value", (F.col("start") + F.col("m") - F.col("m0")).cast("bigint").alias("line")
    )


def load_rollouts(spark: SparkSession, path: str, schema: T.StructType = ROLLOUT_FILE) -> DataFrame:
    """Rollouts from JSON lines; a row without an index takes its line number, other keys are kept in ``extra``."""
    lines = numbered_lines(spark, path).withColumnRenamed("line", "_line")
    return normalise_rollouts(parsed(lines, schema), F.col("_line"))
