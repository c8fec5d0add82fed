"""The online scan statistic on a stream of scored tokens: one-step lag, full window, fire once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracefork.operators.background import WARMUP
from tracefork.schemas import TRACE
from tracefork.streaming.lifetime import Lifetime, fires, fold_stream

VALUES = {"J_t": "double", "tau_t": "string", "lambda_J": "double"}


@dataclass(frozen=True)
class WindowFold:
    """The sum of the last ``w`` scores; fires where a full window passes the token's threshold after the warm-up."""

    w: int
    warmup: int
    state = {"recent": "array<double>"}
    fire = {"tau_hat": "string", "S_t": "double"}

    def start(self) -> tuple:
        return ([],)

    def step(self, acc: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        t, score, tau, threshold = row
        recent = [*acc[0], float(score)][-self.w :]
        total = sum(recent)
        passes = len(recent) == self.w and total > threshold and t >= self.warmup
        return (recent,), (tau, total) if passes else None


def scan_events(scored: DataFrame, w: int = 1, warmup: int = WARMUP, life: Lifetime = Lifetime()) -> DataFrame:
    """Fires of ``(pid, rollout_idx, t, J_t, tau_t, lambda_J)`` rows, and the tokens that no state could take.

    Token ``t`` counts once token ``t + 1`` has arrived, so the newest token is held back.
    """
    wanted = [c for c in (life.event_time, life.last) if c]
    return fold_stream(scored.select(*TRACE, "t", *VALUES, *wanted), VALUES, WindowFold(w, warmup), life, held=1)


def scan_stream(scored: DataFrame, w: int = 1, warmup: int = WARMUP, life: Lifetime = Lifetime()) -> DataFrame:
    """The fires of ``scan_events`` alone."""
    return fires(scan_events(scored, w, warmup, life), WindowFold.fire, "t_hat")


def score_stream(
    tokens: DataFrame,
    score: Callable[[DataFrame, SparkSession], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Score every micro-batch of a token stream and keep the result below ``path``, a folder for each batch.

    ``score`` gets the batch and its session and reads the background itself, so each batch meets the backgrounds that
    are there when it starts: a file table bound to the stream once would be listed once. A batch that is run again
    writes its folder anew; what a reader saw of the first try comes twice, and the scan drops repeated tokens.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        score(batch, batch.sparkSession).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        tokens.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scored_tokens(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``score_stream`` keeps, as a stream for the scan."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)

