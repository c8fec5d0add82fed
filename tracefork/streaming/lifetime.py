"""Folding the steps of many traces as they arrive, with state that is bounded, ends, and loses nothing silently.

A trace is open until it has fired, its last step has been folded, or it has been silent too long. What then stays is a
mark of fixed size, so that late steps can't start it anew; the mark goes after a second silence. Steps that arrive
before the step they follow wait; only so many may, and those that can't wait, or whose gap never closed, are rows of
their own in the output beside the events of the fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracefork.schemas import TRACE
from tracefork.streaming.ordering import StepBuffer

#: Kinds of output rows.
FIRE, UNPLACED, LATE = "fire", "unplaced", "late"
_OPEN, _FIRED, _ENDED = 0, 1, 2


@dataclass(frozen=True)
class Lifetime:
    """How much is kept of a trace, and until when.

    ``event_time`` names a timestamp column with a watermark; silences are then measured in event time, so a replay
    gives the same rows; without it they are measured by the clock. ``last`` names a boolean column that marks a trace's
    final step. A trace silent for ``idle_ms`` has ended; it is forgotten ``forget_ms`` (as long again unless given)
    after that. At most ``max_waiting`` steps of a trace wait for a gap to close.
    """

    event_time: str | None = None
    idle_ms: int | None = None
    forget_ms: int | None = None
    last: str | None = None
    max_waiting: int | None = None

    @property
    def timeout(self) -> str:
        if self.idle_ms is None:
            return GroupStateTimeout.NoTimeout
        return GroupStateTimeout.EventTimeTimeout if self.event_time else GroupStateTimeout.ProcessingTimeTimeout

    def wind(self, state: GroupState, seen: int | None, ended: bool) -> None:
        """Set the timer for the end of the present silence."""
        if self.idle_ms is None:
            return
        forget = self.idle_ms if self.forget_ms is None else self.forget_ms
        if self.event_time:
            due = (seen or 0) + self.idle_ms + (forget if ended else 0)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(forget if ended else self.idle_ms)


class Fold(Protocol):
    """A rule along one trace. ``state`` and ``fire`` list column names with their types."""

    state: Mapping[str, str]
    fire: Mapping[str, str]

    def start(self) -> tuple: ...

    def step(self, acc: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        """The state after ``row`` (``t`` and the values), and the event's values if it fires there."""


def _ddl(columns: Mapping[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def events_schema(values: Mapping[str, str], fold: Fold) -> str:
    return _ddl({"pid": "string", "rollout_idx": "long", "kind": "string", "t": "long", **fold.fire, **values})


def fold_stream(
    steps: DataFrame, values: Mapping[str, str], fold: Fold, life: Lifetime = Lifetime(), held: int = 0
) -> DataFrame:
    """One row for every event: ``pid, rollout_idx, kind, t``, the fold's columns for a fire, the step's values for a
    step that was not folded.

    A step that repeats one already folded or waiting is dropped. ``unplaced`` steps could not wait any longer: of too
    many the one furthest from the gap goes. ``late`` steps came after the end of their trace. Steps behind a fire are
    no concern of the rule and give no row. ``held`` newest steps are kept back for rules that act later.
    """
    more = [life.event_time, F.unix_millis(life.event_time).alias("at_ms")] if life.event_time else []
    if life.last:
        more.append(F.coalesce(F.col(life.last), F.lit(False)).alias("final"))
    read = steps.select(*TRACE, "t", *values, *more)
    names, width = list(values), len(fold.state)
    blank = [[] for _ in range(1 + len(names))]
    columns = ["pid", "rollout_idx", "kind", "t", *fold.fire, *names]
    no_fire, no_step = (None,) * len(fold.fire), (None,) * len(names)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            next_step, phase, last, seen, *rest = state.get
            acc, waits = tuple(rest[:width]), rest[width:]
        else:
            next_step, phase, last, seen, acc, waits = 0, _OPEN, None, None, fold.start(), blank
        out: list[tuple] = []

        def aside(kind: str, row: tuple) -> None:
            out.append((*key, kind, row[0], *no_fire, *row[1:]))

        buffer = StepBuffer(next_step, {row[0]: row for row in zip(*waits)}, held, life.max_waiting)
        if state.hasTimedOut:
            if phase == _ENDED:
                state.remove()
                return
            for row in buffer.left() if phase == _OPEN else ():
                aside(UNPLACED, row)
            phase = _ENDED
        else:
            for frame in frames:
                if life.event_time:
                    seen = max(seen or 0, int(frame["at_ms"].max()))
                if life.last and frame["final"].any():
                    last = int(frame.loc[frame["final"], "t"].max())
                if phase == _ENDED:
                    for row in frame[["t", *names]].itertuples(index=False, name=None):
                        if row[0] >= buffer.next_step:
                            aside(LATE, row)
                    continue
                for row in buffer.take([frame], names):
                    if phase != _OPEN:
                        continue
                    acc, event = fold.step(acc, row)
                    if event is not None:
                        phase = _FIRED
                        out.append((*key, FIRE, row[0], *event, *no_step))
                for row in buffer.spilled() if phase == _OPEN else ():
                    aside(UNPLACED, row)
            if phase == _OPEN and last is not None and buffer.next_step > last - held:
                for row in sorted(r for t, r in buffer.waiting.items() if t > last):
                    aside(LATE, row)
                phase, buffer.next_step = _ENDED, last + 1
        waiting = sorted(buffer.waiting.values()) if phase == _OPEN else []
        packed = [list(c) for c in zip(*waiting)] if waiting else blank
        state.update((buffer.next_step, phase, last, seen, *(acc if phase == _OPEN else fold.start()), *packed))
        life.wind(state, seen, phase == _ENDED)
        if out:
            yield pd.DataFrame(out, columns=columns, dtype=object)

    kinds = {"next_step": "long", "phase": "int", "last": "long", "seen": "long", **fold.state}
    kinds |= {"wait_t": "array<long>", **{f"wait_{n}": f"array<{k}>" for n, k in values.items()}}
    return read.groupBy(*TRACE).applyInPandasWithState(
        update, events_schema(values, fold), _ddl(kinds), "append", life.timeout
    )


def fires(events: DataFrame, columns: Mapping[str, str], step: str) -> DataFrame:
    """The fires alone, with the name that the rule gives the step."""
    return events.where(F.col("kind") == FIRE).select(*TRACE, F.col("t").alias(step), *columns)


def write_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All events into one table with a partition for each kind: the fires, and beside them every step that was left
    out. The file sink writes each row once, also after a restart."""
    return (
        events.writeStream.format("parquet")
        .partitionBy("kind")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
