"""Keyed state machines: task states, progress throttling, rerun coalescing, readiness, feedback queues.

State per key is a few scalars (a queue: the waiting samples) in value and list states with
event-time timers: a key is forgotten once its state says nothing more, or a time to live after
it last mattered, so the state follows the live keys and not the history. Rows of one key and
micro-batch are ordered by time; how many there are is set by the source's rate limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("done", "error", "cancelled")
# Legal transitions of a task.
LEGAL = {
    None: ("pending", "running", "done", "error", "cancelled", "interrupted"),
    "pending": ("running", "done", "error", "cancelled", "interrupted"),
    "running": ("done", "error", "cancelled", "interrupted"),
}
HOUR = 3_600_000
#: samples that one feedback batch takes at most; fixed by the rule
TAKE = 20


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(["ts", "seq"], kind="stable")


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.timestamp() * 1000)


class Machine(StatefulProcessor):
    """A state machine per key. Subclasses say what a row does; the key is forgotten at a timer.

    ``NAMES`` are the output columns after the key, ``STATE`` the state's schema, ``BLANK`` the
    state of a key never seen (a key that is back in it is forgotten at once).
    """

    KEY, NAMES, STATE, BLANK = "task_id", (), "", ()

    def __init__(self, ttl_ms: int = HOUR):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.STATE)

    def read(self, state: list, row) -> tuple | None:  # noqa: ANN001
        """Change ``state`` in place and return an output row (without the key) or None."""
        raise NotImplementedError

    def expires(self, state: list) -> bool:
        return True

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        before = tuple(self.held.get()) if self.held.exists() else tuple(self.BLANK)
        state, made, last = list(before), [], None
        for row in _ordered(rows).itertuples(index=False):
            out, last = self.read(state, row), row.ts
            if out is not None:
                made.append((key[0], *out))
        if tuple(state) != before:  # rows that change nothing don't prolong a key's life
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if tuple(state) == tuple(self.BLANK):
                self.held.clear()
            else:
                self.held.update(tuple(state))
                if self.expires(state):
                    self.handle.registerTimer(max(_ms(last) + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(made, columns=[self.KEY, *self.NAMES])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.held.clear()
        yield pd.DataFrame([], columns=[self.KEY, *self.NAMES])

    def close(self) -> None:
        pass


def _run(events: DataFrame, machine: Machine, schema: str, late: str) -> DataFrame:
    keyed = events.withWatermark("ts", late).groupBy(machine.KEY)
    return keyed.transformWithStateInPandas(machine, schema, "append", "eventTime")


class _TaskStates(Machine):
    NAMES, STATE, BLANK = ("ts", "seq", "status", "n_changes"), "status string, changes long", (None, 0)

    def read(self, state: list, row) -> tuple | None:  # noqa: ANN001
        if row.status not in LEGAL.get(state[0], ()):
            return None
        state[:] = row.status, state[1] + 1
        return row.ts, row.seq, *state

    def expires(self, state: list) -> bool:
        return state[0] in TERMINAL


def task_states(events: DataFrame, ttl_ms: int = HOUR, late: str = "10 seconds") -> DataFrame:
    """Latest state per task from transition events: one row per accepted transition.

    ``events``: task_id, ts, seq, status. Illegal transitions (out of a terminal state,
    backwards) are ignored. A terminal task is forgotten ``ttl_ms`` after it ended. Of the
    rows of one status only a task's first can be accepted, so each Arrow batch sends that one
    to the state and a busy task stays small.
    """

    def first_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.sort_values(["ts", "seq"], kind="stable").drop_duplicates(["task_id", "status"])

    rows = events.select("task_id", "ts", "seq", "status")
    return _run(rows.mapInPandas(first_of_each, rows.schema), _TaskStates(ttl_ms), "task_id long, ts timestamp, seq long, status string, n_changes long", late)


class _Progress(Machine):
    NAMES = ("ts", "seq", "progress", "message")
    STATE, BLANK = "now double, stored double, stored_msg string, msg string", (0.0, -1.0, None, None)

    def __init__(self, ttl_ms: int, step_size: float):
        super().__init__(ttl_ms)
        self.step_size = step_size

    def read(self, state: list, row) -> tuple | None:  # noqa: ANN001
        given, new_msg = not pd.isna(row.progress), isinstance(row.message, str)
        if given:
            state[0] = max(0.0, min(1.0, float(row.progress)))
        if new_msg:
            state[3] = row.message
        if given and abs(state[0] - state[1]) < self.step_size and not (new_msg and state[3] != state[2]):
            return None
        state[1], state[2] = state[0], state[3]
        return row.ts, row.seq, state[0], state[3]


def throttled_progress(events: DataFrame, step_size: float = 0.02, late: str = "10 seconds", ttl_ms: int = 24 * HOUR) -> DataFrame:
    """Progress rows worth storing.

    A row passes when it has no progress, its progress (clamped to [0, 1]) moved by at
    least ``step_size`` since the last stored one, or its message changed. A task without
    events for ``ttl_ms`` is forgotten.
    """
    schema = "task_id long, ts timestamp, seq long, progress double, message string"
    return _run(events, _Progress(ttl_ms, step_size), schema, late)


class _Runs(Machine):
    KEY, NAMES = "project_id", ("ts", "seq", "reason")
    STATE, BLANK = "busy boolean, again boolean", (False, False)

    def read(self, state: list, row) -> tuple | None:  # noqa: ANN001
        busy, again = state
        if row.kind == "request":
            state[:] = True, again or busy
            return None if busy else (row.ts, row.seq, "request")
        rerun = bool(busy and again and row.kind == "done")
        state[:] = rerun, False
        return (row.ts, row.seq, "rerun") if rerun else None

    def expires(self, state: list) -> bool:
        return False  # a run that goes on is never forgotten, an idle project is blank


def coalesced_runs(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Starts of project runs from requests and finishes.

    ``events``: project_id, ts, seq, kind ('request' | 'done' | 'failed'). A request while
    a run is going sets one flag; a successful finish with the flag set starts exactly one
    more run, a failed finish none. Only projects with a run going have state.
    """
    return _run(events, _Runs(), "project_id long, ts timestamp, seq long, reason string", late)


class _Readiness(Machine):
    NAMES, STATE, BLANK = ("ts", "state", "n_done"), "done long, decided boolean", (0, False)

    def read(self, state: list, row) -> tuple | None:  # noqa: ANN001
        if state[1]:
            return None
        state[0] += row.status == "done"
        state[1] = bool(row.status != "done" or state[0] >= row.n_upstream)
        return (row.ts, "ready" if row.status == "done" else "error", state[0]) if state[1] else None

    def expires(self, state: list) -> bool:
        return state[1]


def readiness_stream(finishes: DataFrame, late: str = "10 seconds", ttl_ms: int = HOUR) -> DataFrame:
    """Tasks that became ready or failed, as their upstreams finish.

    ``finishes``: task_id (downstream), n_upstream, upstream, ts, seq, status. The first
    failure decides at once; otherwise the last missing upstream does. A decided task is
    forgotten ``ttl_ms`` after that.
    """
    return _run(finishes, _Readiness(ttl_ms), "task_id long, ts timestamp, state string, n_done long", late)


class _Queue(StatefulProcessor):
    """Samples of a project wait in a list while a feedback job is busy; a finish sends the next ones."""

    NAMES = ["project_id", "batch_no", "item_id", "seg_id", "ts", "seq"]
    SAMPLE = "item_id string, seg_id string, ts timestamp, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.SAMPLE)
        self.job = handle.getValueState("job", "busy boolean, batches long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        busy, batches = self.job.get() if self.job.exists() else (False, 0)
        queue, made = [tuple(x) for x in self.waiting.get()], []
        for row in _ordered(rows).itertuples(index=False):
            if row.kind == "finish":
                busy = False
            else:
                queue.append((row.item_id, row.seg_id, row.ts, row.seq))
            if queue and not busy:
                # the next samples in order of arrival; of one segment the earliest stands for all of them
                queue.sort(key=lambda x: (x[2], x[3]))
                head, queue = queue[:TAKE], queue[TAKE:]
                taken = {}
                for sample in head:
                    taken.setdefault(sample[:2], sample)
                batches, busy = batches + 1, True
                made += [(key[0], batches, *sample) for sample in taken.values()]
        if queue:
            self.waiting.put(queue)
        else:
            self.waiting.clear()
        self.job.update((bool(busy), batches))
        yield pd.DataFrame(made, columns=self.NAMES)

    def close(self) -> None:
        pass


def feedback_batches(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Feedback batches of every project: (project_id, batch_no, item_id, seg_id, ts, seq).

    ``events``: project_id, ts, seq, kind ('sample' | 'finish'), item_id, seg_id. A sample that
    comes while no job is busy starts one; samples that come while one is busy wait. A finish
    starts the next job with the first ``TAKE`` waiting samples, repeats of a segment among
    them reduced to the earliest by (ts, seq), until none waits.
    """
    schema = "project_id long, batch_no long, " + _Queue.SAMPLE
    return events.withWatermark("ts", late).groupBy("project_id").transformWithStateInPandas(_Queue(), schema, "append", "eventTime")
