"""Putting a trace's steps back in order across micro-batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd


class StepBuffer:
    """Hands out steps next, next+1, … once the gap before them has closed.

    Steps that arrive early wait in ``waiting``; repeated steps are dropped. ``held`` newest contiguous
    steps can be kept back for rules that act one step later. With ``most`` no more than that many steps wait, beside
    the held ones: the one furthest from the gap is ``spilled``.
    """

    def __init__(self, next_step: int, waiting: dict[int, tuple], held: int = 0, most: int | None = None) -> None:
        self.next_step = next_step
        self.waiting = waiting
        self.held = held
        self.most = most
        self._spilled: list[tuple] = []

    def take(self, frames: Iterable[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
        for frame in frames:
            for row in frame.sort_values("t")[["t", *columns]].itertuples(index=False, name=None):
                t = int(row[0])
                if t >= self.next_step:
                    self.waiting.setdefault(t, row)
                if self.most is not None and len(self.waiting) > self.most + self.held:
                    yield from self._ready()
                    while len(self.waiting) > self.most + self.held:
                        self._spilled.append(self.waiting.pop(max(self.waiting)))
            yield from self._ready()

    def spilled(self) -> list[tuple]:
        """The steps that could not wait since the last call."""
        out, self._spilled = self._spilled, []
        return out

    def left(self) -> list[tuple]:
        """The steps behind a gap, when nothing more is expected; the held ones before it are done with."""
        while self.next_step in self.waiting:
            self.waiting.pop(self.next_step)
            self.next_step += 1
        return [self.waiting[t] for t in sorted(self.waiting)]

    def _ready(self) -> Iterator[tuple]:
        while self.next_step in self.waiting and all(
            self.next_step + i in self.waiting for i in range(1, self.held + 1)
        ):
            row = self.waiting.pop(self.next_step)
            self.next_step += 1
            yield row
