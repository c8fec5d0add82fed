"""Page-Hinkley detection on a stream of steps: state per rollout, one fire event per rollout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefork.operators.page_hinkley import BETA, MIN_STEP, SIGNALS, detect, first_armed_step
from tracefork.schemas import TRACE
from tracefork.streaming.lifetime import Lifetime, fires, fold_stream


@dataclass(frozen=True)
class ExcessFold:
    """The running mean and the excess sum; fires where the excess passes ``lam``."""

    lam: float
    beta: float
    armed: int
    state = {"mu": "double", "g": "double"}
    fire = {"g_at_fire": "double", "mu_at_fire": "double", "signal_at_fire": "double"}

    def start(self) -> tuple:
        return None, 0.0

    def step(self, acc: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        (mu, g), (t, x) = acc, row
        mu = x if mu is None else (1 - self.beta) * mu + self.beta * x
        if t >= self.armed:
            g = max(0.0, g + (x - mu))
        return (mu, g), (g, mu, x) if t >= self.armed and g > self.lam else None


def detect_events(
    steps: DataFrame,
    lam: float,
    beta: float = BETA,
    min_step: int = MIN_STEP,
    signal_type: str = "demotion",
    life: Lifetime = Lifetime(),
) -> DataFrame:
    """Fires of ``(pid, rollout_idx, t, <signal>)`` rows, and the steps that no state could take (``kind``)."""
    signal = F.col(SIGNALS[signal_type]).cast("double").alias("x")
    wanted = [c for c in (life.event_time, life.last) if c]
    fold = ExcessFold(lam, beta, first_armed_step(beta, min_step))
    return fold_stream(steps.select(*TRACE, "t", signal, *wanted), {"x": "double"}, fold, life)


def detect_stream(
    steps: DataFrame,
    lam: float,
    beta: float = BETA,
    min_step: int = MIN_STEP,
    signal_type: str = "demotion",
    life: Lifetime = Lifetime(),
) -> DataFrame:
    """Streaming twin of the batch detector: the fires alone.

    A new rollout starts from fresh state, which is the reset. After firing only a mark is kept, which ``life`` lets go.
    """
    return fires(detect_events(steps, lam, beta, min_step, signal_type, life), ExcessFold.fire, "step")


@dataclass(frozen=True)
class PageHinkley:
    """The detector plug-in: one setting, over a table or over a stream."""

    lam: float
    beta: float = BETA
    min_step: int = MIN_STEP
    signal_type: str = "demotion"

    def batch(self, steps: DataFrame) -> DataFrame:
        return detect(steps, self.lam, self.beta, self.min_step, self.signal_type)

    def stream(self, steps: DataFrame) -> DataFrame:
        return detect_stream(steps, self.lam, self.beta, self.min_step, self.signal_type)
