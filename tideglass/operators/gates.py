"""Gates of the control loop over event tables: access-anchored quotas, leases, dispatch under a budget, queue transitions."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import OrderedDict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.operators.ordered import CHUNK, HOUR, before_each, folded, running, streamed

MINUTE = HOUR // 60


class Windows:
    """A cell of calls before the window they meet is known: for each instant at which that may end, the window open behind the cell and its calls.

    A window from before the cell has ended `span` after the cell's first call; until then each instant may be the one that opens the next.
    Windows that end before the same call go on as one.
    """

    def __init__(self, span: int):
        self.span, self.first, self.last, self.n = span, None, None, 0
        # windows in the order of their starts: [start, calls of the cell before it, ends of the earlier window that lead to it]
        self.open: deque[list] = deque()
        self.known = False

    def add(self, t: int, *_) -> None:
        if self.first is None:
            self.first = t
        if t != self.last:
            ends = []
            while self.open and self.open[0][0] + self.span <= t:
                old = self.open.popleft()[2]
                ends, old = (ends, old) if len(ends) > len(old) else (old, ends)
                ends += old
            if not self.known:
                self.known = t >= self.first + self.span
                ends.append(t)
            if ends:
                self.open.append([t, self.n, ends])
            self.last = t
        self.n += 1

    def told(self) -> dict:
        steps = []
        for end, start, before in sorted((e, s, n) for s, n, ends in self.open for e in ends):
            if steps and steps[-1][1] == start:
                steps[-1][0] = end
            else:
                steps.append([end, start, self.n - before])
        return {"steps": steps, "n": self.n}

    @staticmethod
    def after(told: dict, state: list | None, span: int) -> list:
        steps = told["steps"]
        i = 0 if state is None else bisect_left(steps, state[0] + span, key=lambda s: s[0])
        return steps[i][1:] if i < len(steps) else [state[0], state[1] + told["n"]]


def quota(calls: DataFrame, by: str, t: str = "t", tie: str = "id", limit: int = 1000, hours: float = 5, width: int | None = None) -> DataFrame:
    """calls with window_start, place and allowed: a key's first call opens a window, and so does the first call `hours` or more after the last opening.

    t is in microseconds.  In a window the first `limit` calls are allowed.  Calls of one instant go in the order of `tie`; calls without a key or
    instant are dropped.
    """
    rows = calls.where(F.col(by).isNotNull() & F.col(t).isNotNull())
    span = round(hours * HOUR)

    def step(state: list | None, at: int) -> tuple:
        start, n = state or (None, 0)
        if start is None or at > start and at >= start + span:
            start, n = at, 0
        return [start, n + 1], (start, n + 1)

    rows = folded(rows, by, [t, tie], [t], lambda: Windows(span), lambda told, state: Windows.after(told, state, span), step, "window_start long, place long", width)
    return rows.withColumn("allowed", F.col("place") <= limit).select(*calls.columns, "window_start", "place", "allowed")


def lease_step(state: list | None, t: int, owner: str, release: bool, ttl: int) -> tuple:
    """(lease [owner, until] or None, outcome) of one event."""
    holds = state is not None and state[1] >= t
    if release:
        return None, ("released" if holds else "none",)
    if holds and state[0] != owner:
        return state, ("refused",)
    return [owner, t + ttl], ("extended" if holds else "claimed",)


class Claims:
    """A cell of claims and releases before the lease they meet is known: for each such lease the one that holds behind the cell.

    A release ends every lease, so all that came before is one case.  Until then a claim takes the leases that have expired and its own
    owner's: all these go on as one, and there is one case an owner.  A lease from before the cell ends within ttl of its first row.
    """

    def __init__(self, ttl: int):
        self.ttl, self.first, self.all, self.state = ttl, None, False, None
        # leases by owner in the order of their ends: [until, case]; cases that went on as one point to it
        self.held: OrderedDict[str, list] = OrderedDict()
        self.into: list[int] = []
        # what became of the lease before: by its end, and by its owner's first claim
        self.ended: list[tuple[int, int]] = []
        self.own: dict[str, tuple[int, int]] = {}
        self.known = False

    def add(self, t: int, owner: str, release: bool) -> None:
        if self.first is None:
            self.first = t
        if release or self.all:
            self.state = lease_step(self.state if self.all else None, t, owner, release, self.ttl)[0]
            self.all = True
            return
        case = None
        mine = self.held.pop(owner, None)
        gone = [] if mine is None else [mine[1]]
        while self.held and (least := next(iter(self.held)), self.held[least][0])[1] < t:
            gone.append(self.held.pop(least)[1])
        if gone:
            case = gone[0]
            for g in gone[1:]:
                self.into[g] = case
        if not self.known:
            meets = not self.ended or t > self.ended[-1][0]
            if case is None and (meets or owner not in self.own):
                case = len(self.into)
                self.into.append(case)
            if meets:
                self.ended.append((t, case))
            if owner not in self.own:
                self.own[owner] = (t, case)
            self.known = t >= self.first + self.ttl
        if case is not None:
            self.held[owner] = [t + self.ttl, case]

    def told(self) -> dict:
        if self.all:
            return {"all": self.state}
        lease = {case: [owner, until] for owner, (until, case) in self.held.items()}

        def behind(case: int) -> list:
            while self.into[case] != case:
                self.into[case] = case = self.into[self.into[case]]
            return lease[case]

        ended = []
        for t, case in self.ended:
            if ended and ended[-1][1] == behind(case):
                ended[-1][0] = t
            else:
                ended.append([t, behind(case)])
        return {"ended": ended, "own": {o: [t, behind(case)] for o, (t, case) in self.own.items()}}

    @staticmethod
    def after(told: dict, state: list | None) -> list | None:
        if "all" in told:
            return told["all"]
        if state is None:
            return told["ended"][0][1]
        owner, until = state
        own = told["own"].get(owner)
        if own and until >= own[0]:
            return own[1]
        # a lease still holds in its last instant
        i = bisect_right(told["ended"], until, key=lambda e: e[0])
        return told["ended"][i][1] if i < len(told["ended"]) else state


def leases(events: DataFrame, by: str, owner: str, release: Column, t: str = "t", tie: str = "id", ttl: int = HOUR, width: int | None = None) -> DataFrame:
    """events with outcome: claims are `claimed`, `extended` or `refused`, releases are `released` or, without a lease, `none`.

    A claim takes the task's lease for ttl microseconds if none holds; the owner's further claims extend it, those of others are
    refused and change nothing; a release ends it, whoever asks.  A lease still holds in its last instant.  Rows without a
    task, owner or instant are dropped; order is by t, then tie, which tells a task's rows apart.
    """
    rows = events.where(F.col(by).isNotNull() & F.col(t).isNotNull() & F.col(owner).isNotNull())
    rows = rows.withColumns({"_release": F.coalesce(release, F.lit(False)), "_owner": F.col(owner).cast("string")})
    step = lambda state, at, who, frees: lease_step(state, at, who, frees, ttl)
    return folded(rows, by, [t, tie], [t, "_owner", "_release"], lambda: Claims(ttl), Claims.after, step, "outcome string", width).select(*events.columns, "outcome")


class Dispatcher:
    """One queue's state: ends of admitted runs on a heap of `budget` at most, and the leases of their tasks."""

    def __init__(self, budget: int, ttl: int):
        self.budget, self.ttl, self.active, self.held = budget, ttl, [], {}

    def admit(self, t: int, end: int, task: str, owner: str) -> str | None:
        """The reason why a run is not admitted at t, or None."""
        while self.active and self.active[0][0] <= t:
            self.held.pop(heapq.heappop(self.active)[1], None)
        if self.budget is not None and len(self.active) >= self.budget:
            return "no_budget"
        who, until = self.held.get(task, (owner, t))
        if who != owner and until >= t:
            return "skip"
        self.held[task] = (owner, t + self.ttl)
        heapq.heappush(self.active, (end, task))
        return None


def run_end(t: str, ended: str, max_age: int) -> Column:
    """When a run stops to be active: at its end, or swept at its greatest age."""
    return F.least(F.coalesce(F.col(ended), F.col(t) + max_age), F.col(t) + max_age)


def dispatch(runs: DataFrame, by: str, t: str = "t", tie: str = "id", budget: int | None = 10, ttl: int = 300_000_000, max_age: int = 600_000_000, width: int = MINUTE) -> DataFrame:
    """(by, id, outcome) of runs (by, id, task, owner, t, ended, failed, cancelled): no_budget, skip, interrupted, failed or success.

    A run is refused while `budget` admitted runs of its queue are active, and skipped while another owner's lease holds its task; refused and
    skipped runs hold nothing.  The end of a run frees its task; one that does not end within max_age is swept.  Admission is a
    fold, but where no run of the queue, admitted or not, is active the state is empty: there the queue is cut, and the pieces are
    folded apart.  A piece without such a point is one streaming task whose state has `budget` entries at most.
    """
    rows = runs.where(F.col(by).isNotNull() & F.col(t).isNotNull()).withColumn("_end", run_end(t, "ended", max_age))
    rows = running(rows, [by], [t, tie], F.col("_end"), "_busy", width, how="max", own=False)
    idle = F.col("_busy").isNull() | (F.col("_busy") <= F.col(t))
    rows = running(rows, [by], [t, tie], F.when(idle, F.col(t)), "_piece", width)
    late = F.coalesce(F.col("ended"), F.col("_end") + 1) > F.col("_end")
    ends = F.when(F.col("cancelled") | late, "interrupted").when(F.col("failed"), "failed").otherwise("success")
    rows = rows.select(F.col(by).cast("string").alias("q"), "_piece", F.col(tie).cast("long").alias("id"), F.col("task").cast("string").alias("task"), F.col("owner").cast("string").alias("owner"), F.col(t).alias("t"), "_end", ends.alias("ends"))

    def step(state: Dispatcher, r: dict) -> tuple:
        refused = state.admit(r["t"], r["_end"], r["task"], r["owner"])
        return state, {by: r["q"], tie: r["id"], "outcome": refused or r["ends"]}

    return streamed(rows, ["q", "_piece"], ["t", "id"], lambda: Dispatcher(budget, ttl), step, f"{by} string, {tie} long, outcome string")


# A queue's control state: the current task (0 pending, 1 running, 2 paused), and whether a paused one is to be taken next (+3).
def _queue_step(op: str, s: int) -> tuple[int, int, int | None]:
    """(next state, tasks moved on, new status of the current task before moving: 1 running, 2 paused, 3 completed, 4 failed)."""
    now, flag = s % 3, s // 3 * 3
    if op == "pause":
        return 5, 0, 2
    if op in ("complete", "fail"):
        return flag, 1, 3 if op == "complete" else 4
    if op != "next":
        return s, 0, None
    if flag:
        return now, 0, None
    # a task that is not pending is passed over; the one behind it is pending and starts
    return 1, 0 if now == 0 else 1, None


OPS = ("next", "pause", "complete", "fail")
STATUS = {1: "running", 2: "paused", 3: "completed", 4: "failed"}


def _after(a: list[float], b: list[float]) -> list[float]:
    """Queue maps: for each of 6 states the next state, then the tasks moved on."""
    return [b[int(s)] for s in a[:6]] + [a[6 + i] + b[6 + int(s)] for i, s in enumerate(a[:6])]


def queue_steps(ops: DataFrame, by: str, order: str = "seq", width: int = CHUNK) -> DataFrame:
    """(by, seq, place, status) of ops (by, seq, op): the places, from 0, whose status each op sets; numbers seq tell a queue's ops apart.

    An op is a map of six control states; maps compose, so chunks of ops are composed apart, then level upon level, and last the ops of a
    chunk are walked from the state that stands before it.  Other ops change nothing; the list of tasks is endless here.
    """
    import pyarrow as pa

    table = {op: [float(_queue_step(op, s)[0]) for s in range(6)] + [float(_queue_step(op, s)[1]) for s in range(6)] for op in (*OPS, None)}
    rows = ops.select(F.col(by).cast("string").alias("q"), F.col(order).cast("long").alias("seq"), F.when(F.col("op").isin(*OPS), F.col("op")).alias("op")).where("q is not null and seq is not null")
    rows = rows.withColumn("c", F.floor(F.col("seq") / width))

    def whole(t: pa.Table) -> pa.Table:
        now = None
        for r in sorted(t.to_pylist(), key=lambda r: r["seq"]):
            now = table[r["op"]] if now is None else _after(now, table[r["op"]])
        return pa.table({"q": t["q"].slice(0, 1), "c": t["c"].slice(0, 1), "v": pa.array([now], pa.list_(pa.float64()))})

    maps = rows.groupBy("q", "c").applyInArrow(whole, "q string, c long, v array<double>")
    before = before_each(maps, ["q"], _after, width)

    def walk(t: pa.Table) -> pa.Table:
        out = []
        first = t["before"][0].as_py()
        s, place = (int(first[0]), int(first[6])) if first else (0, 0)
        for r in sorted(t.to_pylist(), key=lambda r: r["seq"]):
            nxt, moved, status = _queue_step(r["op"], s)
            starts = r["op"] == "next" and nxt == 1 and s < 3
            out.append((r["q"], r["seq"], place + (moved if starts else 0), "running" if starts else STATUS.get(status), place + moved))
            s, place = nxt, place + moved
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["q", "seq", "place", "status", "now"])

    walked = rows.join(before, ["q", "c"]).groupBy("q", "c").applyInArrow(walk, "q string, seq long, place long, status string, now long")
    return walked.select(F.col("q").alias(by), F.col("seq").alias(order), "place", "status", "now")


def queue_state(tasks: DataFrame, ops: DataFrame, by: str, order: str = "seq", width: int = CHUNK) -> DataFrame:
    """tasks (by, place, ...) with status and current: what ops leave of queues whose tasks, numbered from 0, were all pending.

    current marks the task at the queue's index; where the index is behind the last task, none is.
    """
    steps = queue_steps(ops, by, order, width)
    last = steps.where("status is not null").groupBy(by, "place").agg(F.max_by("status", order).alias("status"))
    index = steps.groupBy(by).agg(F.max("now").alias("_now"))
    rows = tasks.join(last, [by, "place"], "left").join(index, by, "left")
    return rows.select(*tasks.columns, F.coalesce("status", F.lit("pending")).alias("status"), (F.col("place") == F.coalesce("_now", F.lit(0))).alias("current"))


