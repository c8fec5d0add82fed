"""Streaming queries, run to the end of their input and read back; each has a batch twin's oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefork.catalog import inputs as I
from tracefork.catalog.detector_queries import _FIRE, _FIRE_COLS, fold_sql, recursive
from tracefork.catalog.registry import pick, pick_sql, query, r6, s6
from tracefork.catalog.token_queries import background, scored, scores
from tracefork.catalog.trace_queries import replay_sql
from tracefork.schemas import TRACE
from tracefork.operators.token_features import score_against
from tracefork.session import fresh_path
from tracefork.sources.feature_cache import scan_cell
from tracefork.streaming.incremental import extract_stream, extract_topk_stream
from tracefork.streaming.lifetime import Lifetime, write_events
from tracefork.streaming.page_hinkley import detect_events, detect_stream
from tracefork.streaming.scan_statistic import scan_stream, score_stream, scored_tokens

FILES = 4


def as_stream(df: DataFrame, label: str, *scatter: str) -> DataFrame:
    """The rows as a file stream, scattered over several files taken one per micro-batch."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.repartition(FILES, *scatter).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    out = fresh_path(spark, label)
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", fresh_path(spark, f"{label}-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("i1_online_page_hinkley", recursive(*fold_sql("d_t", 20, 8.0), _FIRE))
def i1(spark, sf):
    """Steps arrive out of order: files are cut by a hash of the step."""
    steps = as_stream(I.signal_traces(spark, sf), "steps", "t")
    fires = run_to_end(detect_stream(steps, lam=8.0), "fires")
    return pick(fires, [*TRACE, "step"], _FIRE_COLS)


@query("i2_online_scan_statistic", I.with_sql(*replay_sql(2), f"SELECT pid, rollout_idx, t AS t_hat, tau_t AS tau_hat, {s6('S_t')} FROM rf"))
def i2(spark, sf):
    tokens = scored(spark, sf).select(*TRACE, "t", "J_t", "tau_t", "lambda_J")
    fires = run_to_end(scan_stream(as_stream(tokens, "tokens", "t"), w=2), "scan-fires")
    return pick(fires, [*TRACE, "t_hat", "tau_hat"], ["S_t"])


@query("i3_incremental_features", I.with_sql(*I.FEATURES, f"SELECT pid, rollout_idx, count(*) AS length, round(avg(J_approx), 3) + 0 AS j FROM ft GROUP BY pid, rollout_idx"))
def i3(spark, sf):
    """Rollouts stream in, some of them twice; the cache ends with each once."""
    seq = I.sequences(spark, sf)
    twice = seq.unionByName(seq.where(F.col("rollout_idx") == 0))
    cache = fresh_path(spark, "incremental-cache")
    extract_stream(
        as_stream(twice, "sequences"), I.topk(spark, sf), cache, "arith", "base",
        fresh_path(spark, "incremental-checkpoint"), k_cov=I.K_COV, ranks="trusted",
    ).awaitTermination()
    mean = F.aggregate("J_approx", F.lit(0.0), lambda a, x: a + x) / F.size("J_approx")
    return scan_cell(spark, cache, "arith", "base").select(
        *TRACE, F.size("J_approx").cast("bigint").alias("length"), F.round(mean, 3).alias("j")
    )


def in_turn(parts: list[DataFrame], label: str) -> DataFrame:
    """The parts as a file stream, one per micro-batch in their order."""
    spark = parts[0].sparkSession
    path = fresh_path(spark, label)
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/part={i}")
    return (
        spark.readStream.schema(parts[0].schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def events_of(events: DataFrame, label: str) -> DataFrame:
    spark = events.sparkSession
    out = fresh_path(spark, label)
    write_events(events, out, fresh_path(spark, f"{label}-checkpoint")).awaitTermination()
    return spark.read.schema(events.schema).parquet(out)


def timed(steps: DataFrame) -> DataFrame:
    """Steps with the second of their arrival, counted from one moment for all traces."""
    return steps.withColumn("at", F.timestamp_seconds(F.lit(1_000_000) + F.col("t"))).select(*TRACE, "t", "d_t", "at", "last")


def silence(spark, seconds: int) -> DataFrame:
    """A step of a trace of its own, that much later: it moves the watermark."""
    at = F.timestamp_seconds(F.lit(1_000_000 + seconds)).alias("at")
    return spark.range(1).select(
        F.lit("clock").alias("pid"), F.lit(0).cast("bigint").alias("rollout_idx"), F.lit(seconds).cast("bigint").alias("t"),
        F.lit(0.0).alias("d_t"), at, F.lit(False).alias("last"),
    )


LIFE = Lifetime(event_time="at", idle_ms=60_000, last="last", max_waiting=5)


@query(
    "i4_end_of_trace",
    recursive(
        *fold_sql("d_t", 20, 8.0),
        """SELECT pid, CAST(0 AS BIGINT) AS rollout_idx, 'fire' AS kind, t FROM fh UNION ALL
        SELECT pid, CAST(0 AS BIGINT), 'late', max(t) + d FROM sg, (VALUES (1), (4)) v(d)
        WHERE pid NOT IN (SELECT pid FROM fh) GROUP BY pid, d""",
    ),
)
def i4(spark, sf):
    """Traces end with a marked step; afterwards each is sent again as a whole, with two steps more."""
    signal = I.signal_traces(spark, sf).select(*TRACE, "t", "d_t")
    lengths = signal.groupBy(*TRACE).agg(F.max("t").alias("end"))
    steps = timed(signal.join(lengths, TRACE).withColumn("last", F.col("t") == F.col("end")))
    more = lengths.select(*TRACE, F.explode(F.array(F.col("end") + 1, F.col("end") + 4)).alias("t"), F.lit(5.0).alias("d_t"), F.lit(False).alias("last"))
    again = steps.withColumn("last", F.lit(False)).unionByName(timed(more))
    stream = in_turn([steps.where("t < 40"), steps.where("t >= 40"), again], "ending").withWatermark("at", "1 hour")
    events = events_of(detect_events(stream, lam=8.0, life=LIFE), "ending-events")
    return events.select(*TRACE, "kind", "t")


@query(
    "i5_unplaced_steps",
    recursive(
        *fold_sql("d_t", 20, 8.0),
        """SELECT pid, CAST(0 AS BIGINT) AS rollout_idx, 'fire' AS kind, t FROM fh WHERE CAST(pid AS BIGINT) % 4 <> 0 OR t < 30 UNION ALL
        SELECT pid, CAST(0 AS BIGINT), 'unplaced', t FROM sg WHERE CAST(pid AS BIGINT) % 4 = 0 AND t > 30
        AND pid NOT IN (SELECT pid FROM fh WHERE t < 30)""",
    ),
)
def i5(spark, sf):
    """Step 30 of every fourth trace never comes: at most five steps wait for it, and all behind it are told."""
    signal = I.signal_traces(spark, sf).select(*TRACE, "t", "d_t").where("CAST(pid AS BIGINT) % 4 <> 0 OR t <> 30")
    steps = timed(signal.withColumn("last", F.lit(False)))
    clock = [silence(spark, s) for s in (1_000, 2_000, 3_000)]
    stream = in_turn([steps.where("t < 35"), steps.where("t >= 35"), *clock], "gaps").withWatermark("at", "10 seconds")
    events = events_of(detect_events(stream, lam=8.0, life=LIFE), "gap-events")
    return events.where("pid <> 'clock'").select(*TRACE, "kind", "t")


_TURN = 30


@query(
    "i2_changing_background",
    I.with_sql(
        *[
            part.replace("sk AS (SELECT *,", f"sk AS (SELECT * REPLACE (CASE WHEN t < {_TURN} THEN lambda_J ELSE 0.6 * lambda_J END AS lambda_J),")
            for part in replay_sql(2)
        ],
        f"SELECT pid, rollout_idx, t AS t_hat, tau_t AS tau_hat, {s6('S_t')} FROM rf",
    ),
)
def i2_changing(spark, sf):
    """Backgrounds are estimated anew while traces run: tokens from 30 on meet lower thresholds."""
    versions, path, checkpoint = (fresh_path(spark, f"background-{n}") for n in ("versions", "scored", "checkpoint"))
    found = background(spark, sf)
    tokens = scores(spark, sf)
    source = fresh_path(spark, "token-source")

    def score(batch, session):
        read = session.read.parquet(versions)
        newest = read.agg(F.max("version")).head()[0]
        return score_against(batch, read.where(F.col("version") == newest).drop("version")).select(*TRACE, "t", "J_t", "tau_t", "lambda_J")

    for version, (part, share) in enumerate(((F.col("t") < _TURN, 1.0), (F.col("t") >= _TURN, 0.6))):
        own = found.withColumn("lambda_J", F.col("lambda_J") * share)
        own.write.parquet(f"{versions}/version={version}")
        tokens.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(tokens.schema).parquet(source)
        score_stream(stream, score, path, checkpoint).awaitTermination()
    schema = "pid string, rollout_idx long, t long, J_t double, tau_t string, lambda_J double"
    fired = run_to_end(scan_stream(scored_tokens(spark, path, schema), w=2), "changing-fires")
    return pick(fired, [*TRACE, "t_hat", "tau_hat"], ["S_t"])


@query("i3_topk_files_read_once", I.with_sql(*I.FEATURES, f"SELECT pid, rollout_idx, count(*) AS length, round(avg(J_approx), 3) + 0 AS j FROM ft GROUP BY pid, rollout_idx"))
def i3_files(spark, sf):
    """Top-K rows stream in, cut by position so that every rollout is spread over all batches."""
    cache, pending, checkpoint = (fresh_path(spark, f"topk-{n}") for n in ("cache", "pending", "checkpoint"))
    extract_topk_stream(
        as_stream(I.topk(spark, sf), "topk-files", "pos"), lambda session: I.sequences(session, sf), cache, "arith", "base",
        pending, checkpoint, k_cov=I.K_COV, ranks="trusted",
    ).awaitTermination()
    mean = F.aggregate("J_approx", F.lit(0.0), lambda a, x: a + x) / F.size("J_approx")
    return scan_cell(spark, cache, "arith", "base").select(
        *TRACE, F.size("J_approx").cast("bigint").alias("length"), F.round(mean, 3).alias("j")
    )
