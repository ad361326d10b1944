"""The stop-and-reverse recursion over sorted rows that pass one by one.

`Forgetting` cuts a chunk of bars down to its head. A reversal sets the state to values
read from the data, so two runs over the same bars that entered in different states soon
agree to the last bit, and then for good. The head reaches to a bar by which a run that
entered rising and one that entered falling have long agreed; its last row carries the
state there and the state at the end of the chunk. `Chain` runs along the heads of a
series with the true state: where it agrees at the end of a head, it goes on from the end
of the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa

# Level, trend, extreme point, acceleration.
State = tuple[float, int, float, float]
MARK = pa.struct([(f"{at}_{name}", pa.float64()) for at in ("sync", "end") for name in ("p", "t", "ep", "af")])
# Reversals after the two runs agree that still belong to the head. The true run is a third
# one and may need longer: with 2 every fourth chunk missed it, with 8 one in a thousand.
SPARE = 10


def advance(state: State, high: float, low: float, af_step: float, af_max: float) -> State:
    """State after one more bar; the same arithmetic as `stop_and_reverse.step`."""
    p, t, ep, af = state
    moved = p + (ep - p) * af
    if t == 1:
        if low < moved:
            return ep, -1, low, af_step
        if high > ep:
            return moved, 1, high, min(af + af_step, af_max)
    else:
        if high > moved:
            return ep, 1, high, af_step
        if low < ep:
            return moved, -1, low, min(af + af_step, af_max)
    return moved, t, ep, af


class Forgetting:
    """The run over one chunk."""

    def __init__(self, af_step: float, af_max: float, spare: int = SPARE) -> None:
        self.af_step, self.af_max, self.spare = af_step, af_max, spare
        self.rising = self.falling = None
        self.sync: State | None = None
        self.gap = False

    def takes(self, high: float | None, low: float | None) -> bool:
        """Run over a bar; whether it belongs to the head."""
        if high is None or low is None:
            # In the head the bar itself shows the gap.
            head = self.sync is None and not self.gap
            self.gap = True
            return head
        if self.gap:
            return False
        if self.rising is None:
            self.rising, self.falling = (low, 1, high, self.af_step), (high, -1, low, self.af_step)
            return True
        agreed = self.rising == self.falling
        before = self.rising[1]
        self.rising = advance(self.rising, high, low, self.af_step, self.af_max)
        if self.sync is not None:
            return False
        if not agreed:
            self.falling = advance(self.falling, high, low, self.af_step, self.af_max)
            return True
        self.falling = self.rising
        self.spare -= self.rising[1] != before
        if not self.spare:
            self.sync = self.rising
        return True

    def mark(self) -> dict[str, float | None] | None:
        """What the last row of the head carries; none if the head is the whole chunk."""
        if self.sync is None:
            return None
        end = (None,) * 4 if self.gap else self.rising
        return dict(zip(MARK.names, (*self.sync, *end), strict=True))


class Chain:
    """The run over the heads of one series, or over all its bars."""

    def __init__(self, af_step: float, af_max: float) -> None:
        self.af_step, self.af_max = af_step, af_max
        self.state: State | None = None
        self.unknown = self.lost = False

    def take(self, high: float | None, low: float | None, close: float | None, mark: dict | None) -> None:
        if self.unknown or self.lost:
            return
        if high is None or low is None or (self.state is None and close is None):
            self.unknown = True
            return
        if self.state is None:
            self.state = (close, 1, high, self.af_step)
        else:
            self.state = advance(self.state, high, low, self.af_step, self.af_max)
        if mark is None:
            return
        if mark["end_p"] is None:
            self.unknown = True
        elif self.state == tuple(mark[f"sync_{x}"] for x in ("p", "t", "ep", "af")):
            self.state = tuple(mark[f"end_{x}"] for x in ("p", "t", "ep", "af"))
        else:
            self.lost = True

    @property
    def level(self) -> float | None:
        return None if self.unknown or self.lost or self.state is None else self.state[0]


def heads(af_step: float, af_max: float, spare: int = SPARE):
    """Rows sorted by task, chunk and date to the rows of the heads, with a `mark` added."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task: Any = None
        run = None
        # The last row of the head so far, if an earlier batch had it: its mark is not known yet.
        held: pa.RecordBatch | None = None

        def marked(rows: pa.RecordBatch, marks: list[dict | None]) -> pa.RecordBatch:
            columns = [*rows.columns, pa.array(marks, MARK)]
            return pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "mark"])

        for batch in batches:
            payload = batch.select([n for n in batch.schema.names if n != "chunk"])
            names = ("task", "chunk", "high", "low")
            kept: list[int] = []
            marks: list[dict | None] = []
            here = False  # whether the run has rows in `kept`
            for at, (*key, high, low) in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                if run is None or key != task:
                    if here:
                        marks[-1] = run.mark()
                    elif held is not None:
                        yield marked(held, [run.mark()])
                        held = None
                    task, run, here = key, Forgetting(af_step, af_max, spare), False
                if run.takes(high, low):
                    if held is not None:
                        yield marked(held, [None])
                        held = None
                    kept.append(at)
                    marks.append(None)
                    here = True
            rows = payload.take(pa.array(kept, pa.int64()))
            if here:
                held = rows.slice(len(kept) - 1)
                rows, marks = rows.slice(0, len(kept) - 1), marks[:-1]
            yield marked(rows, marks)
        if held is not None:
            yield marked(held, [run.mark()])

    return cut


def levels(af_step: float, af_max: float):
    """Rows sorted by series and date to `task, psar, lost`: one row a series."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run = None, None

        def out(done: list[tuple[Any, Chain]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key for key, _ in done], pa.string()),
                    pa.array([c.level for _, c in done], pa.float64()),
                    pa.array([c.lost for _, c in done], pa.bool_()),
                ],
                names=["task", "psar", "lost"],
            )

        for batch in batches:
            done = []
            names = ("task", "high", "low", "close", "mark")
            for key, *bar in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if run is None or key != task:
                    if run is not None:
                        done.append((task, run))
                    task, run = key, Chain(af_step, af_max)
                run.take(*bar)
            yield out(done)
        if run is not None:
            yield out([(task, run)])

    return chain
