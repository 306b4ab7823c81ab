"""Keyed state of the control loop in Structured Streaming: the gates of operators/gates.py and the credit walk, row by row.

Each processor keeps a few numbers a key (the dispatcher up to its budget, the credit walk its last 8 outcomes) and clears by an
event-time timer what the batch form would no longer read.  The rows of a key in one micro-batch are taken in order of t and id;
rows of later micro-batches must not be earlier.  The session needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass), as transformWithState does.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from tideglass.operators.gates import STATUS, Dispatcher, _queue_step
from tideglass.operators.ordered import HOUR


def in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.t, r.id))


class Fold(StatefulProcessor):
    """step(state, row) -> (state, output values) with one small state a key; expires(state) is its last instant in microseconds."""

    def __init__(self, step: Callable, state: str, expires: Callable | None = None):
        self.step, self.kind, self.expires = step, state, expires

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.state.get() if self.state.exists() else None
        state = tuple(state) if state is not None else None
        for row in in_order(rows):
            state, told = self.step(state, row)
            yield Row(**dict(zip(self.names, (key[0], row.id, *told))))
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        if self.expires:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if state is not None:
                self.handle.registerTimer(self.expires(state) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())


def _keyed(stream: DataFrame, by: str, processor: StatefulProcessor, out: str, timed: bool) -> DataFrame:
    processor.names = [x.split()[0] for x in out.split(", ")]
    return stream.groupBy(by).transformWithState(processor, out, "Append", "EventTime" if timed else "None")


def quota(stream: DataFrame, by: str, limit: int = 1000, hours: float = 5) -> DataFrame:
    """(by, id, window_start, place, allowed) of calls (by, id, t, ...) with a watermark: gates.quota as calls come."""
    length = round(hours * HOUR)

    def step(state, row):
        start, used = state if state and row.t < state[0] + length else (row.t, 0)
        return (start, used + 1), (start, used + 1, used < limit)

    return _keyed(stream, by, Fold(step, "start long, used long", lambda s: s[0] + length), f"{by} long, id long, window_start long, place long, allowed boolean", True)


def leases(stream: DataFrame, by: str, ttl: int = HOUR) -> DataFrame:
    """(by, id, outcome) of events (by, id, t, owner, release, ...) with a watermark: gates.leases as events come."""

    def step(state, row):
        owner, until = state or (None, row.t - 1)
        held = until >= row.t
        if row.release:
            return None, ("released" if held else "none",)
        if held and owner != row.owner:
            return (owner, until), ("refused",)
        return (row.owner, row.t + ttl), ("extended" if held else "claimed",)

    return _keyed(stream, by, Fold(step, "owner string, until long", lambda s: s[1]), f"{by} long, id long, outcome string", True)


def queue_steps(stream: DataFrame, by: str) -> DataFrame:
    """(by, id, place, status, now) of ops (by, id, t, op): gates.queue_steps as ops come."""

    def step(state, row):
        s, place = state or (0, 0)
        nxt, moved, status = _queue_step(row.op, s)
        starts = row.op == "next" and nxt == 1 and s < 3
        return (nxt, place + moved), (place + (moved if starts else 0), "running" if starts else STATUS.get(status), place + moved)

    return _keyed(stream, by, Fold(step, "s int, place long"), f"{by} string, id long, place long, status string, now long", False)


class Dispatching(StatefulProcessor):
    """A queue's active runs and leases as two lists."""

    def __init__(self, budget: int | None, ttl: int, max_age: int):
        self.budget, self.ttl, self.max_age = budget, ttl, max_age

    def init(self, handle) -> None:
        self.active = handle.getListState("active", "until long, task string")
        self.held = handle.getListState("held", "task string, owner string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        d = Dispatcher(self.budget, self.ttl)
        d.active = [tuple(x) for x in self.active.get()]
        heapq.heapify(d.active)
        d.held = {x[0]: (x[1], x[2]) for x in map(tuple, self.held.get())}
        for r in in_order(rows):
            swept = r.t + self.max_age
            end = swept if r.ended is None else min(r.ended, swept)
            ends = "interrupted" if r.cancelled or r.ended is None or r.ended > swept else "failed" if r.failed else "success"
            yield Row(**dict(zip(self.names, (key[0], r.id, d.admit(r.t, end, r.task, r.owner) or ends))))
        for state, rest in ((self.active, d.active), (self.held, [(t, o, u) for t, (o, u) in d.held.items()])):
            if rest:
                state.put(rest)
            else:
                state.clear()


def dispatch(stream: DataFrame, by: str, budget: int | None = 10, ttl: int = 300_000_000, max_age: int = 600_000_000) -> DataFrame:
    """(by, id, outcome) of runs (by, id, t, task, owner, ended, failed, cancelled): gates.dispatch as runs come."""
    return _keyed(stream, by, Dispatching(budget, ttl, max_age), f"{by} string, id long, outcome string", False)


class Credit(StatefulProcessor):
    """The walk of two credits, clamped to [0, 1], as a value, and the last outcomes as a list beside it."""

    def __init__(self, start: float, step: float, last: int):
        self.start, self.step, self.last = start, step, last

    def init(self, handle) -> None:
        self.credit = handle.getValueState("credit", "builder double, critic double")
        self.history = handle.getListState("history", "outcome double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        builder, critic = tuple(self.credit.get()) if self.credit.exists() else (self.start, self.start)
        history = [x[0] for x in self.history.get()]
        for row in in_order(rows):
            d = self.step if row.outcome is not None and row.outcome > 0 else -self.step
            builder, critic = min(max(builder + d, 0.0), 1.0), min(max(critic - d, 0.0), 1.0)
            history = [*history, row.outcome][-self.last :]
            yield Row(**dict(zip(self.names, (key[0], row.id, builder, critic, list(history)))))
        self.credit.update((builder, critic))
        self.history.put([(x,) for x in history])


def credit(stream: DataFrame, by: str, start: float = 0.5, step: float = 0.01, last: int = 8) -> DataFrame:
    """(by, id, builder, critic, history) after each of the outcomes (by, id, t, outcome): decide.credit as outcomes come."""
    return _keyed(stream, by, Credit(start, step, last), f"{by} string, id long, builder double, critic double, history array<double>", False)


class BoundedLog:
    """The newest n rows of each key of a stream, as a table that each micro-batch replaces: the sink of foreachBatch.

    A version is a folder named by its batch.  A batch that is replayed is merged again into the version before it, and a row that comes
    twice (same key, order and content) is kept once; so neither changes the log.  A version counts once its write is complete;
    all but the last two are deleted.
    """

    def __init__(self, path: str, by: str, order: list[str], n: int):
        self.path, self.by, self.order, self.n = path, by, order, n

    def _fs(self, spark, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def versions(self, spark) -> list[int]:
        fs, p = self._fs(spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if n.startswith("batch-") and fs.exists(self._fs(spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n[6:]) for n in done)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        from tideglass.operators.control import recent

        spark = batch.sparkSession
        before = [v for v in self.versions(spark) if v < batch_id]
        rows = batch
        if before:
            rows = spark.read.schema(batch.schema).parquet(f"{self.path}/batch-{before[-1]}").unionByName(batch)
        recent(rows.distinct(), self.by, self.order, self.n).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        for old in before[:-1]:
            fs, p = self._fs(spark, f"{self.path}/batch-{old}")
            fs.delete(p, True)

    def read(self, spark, schema=None) -> DataFrame | None:
        have = self.versions(spark)
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(f"{self.path}/batch-{have[-1]}") if have else None
