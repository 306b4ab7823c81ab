"""Quotas, leases, dispatch and queues: against their SQL, against plain loops, and as streams."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tideglass.operators import control, decide, gates, ordered
from tideglass.operators.ordered import HOUR
from tideglass.plans import gate_queries as q
from tideglass.streaming import stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def wanted(con, name):
    found = con.execute(q.ORACLE_SQL[name])
    return [dict(zip([c[0] for c in found.description], r)) for r in found.fetchall()]


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    want = wanted(con, name)
    assert sorted((tuple(r[c] for c in df.columns) for r in want), key=str) == sorted(map(tuple, df.collect()), key=str)
    kinds = {"leases": {"claimed", "extended", "refused", "released", "none"}, "dispatch_outcomes": {"no_budget", "skip", "interrupted", "failed", "success"}, "lease_outcomes": {"skip", "interrupted", "failed", "success"}, "queue_transitions": {"pending", "running", "paused", "completed", "failed"}}
    if name in kinds:
        assert {r.get("outcome", r.get("status")) for r in want} == kinds[name]


def test_a_skipped_run_holds_nothing(spark):
    rows = [("a", 1, "x", "o1", 0, 100), ("a", 2, "x", "o2", 50, 500), ("a", 3, "x", "o3", 200, 250)]
    runs = spark.createDataFrame([(*r, False, False) for r in rows], "q string, id long, task string, owner string, t long, ended long, failed boolean, cancelled boolean")
    got = {r.id: r.outcome for r in gates.dispatch(runs, "q", budget=10, ttl=1000, max_age=600).collect()}
    assert got == {1: "success", 2: "skip", 3: "success"}


def test_hot_keys_ties_and_bursts(spark):
    """One key with most rows, equal instants and cells of one microsecond to a day give the same as a loop."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc"), i, rng.choice([rng.randrange(40), rng.randrange(3000), 500]), rng.choice("xyz"), rng.random() < 0.1) for i in range(300)]
    rows += [(None, 800, 1, "x", False), ("a", 801, None, "x", False)]
    frame = spark.createDataFrame(rows, "k string, id long, t long, owner string, rel boolean").repartition(6)
    want_quota, want_lease, state, lease = {}, {}, {}, {}
    for k, i, t, owner, rel in sorted((r for r in rows if r[0] and r[2] is not None), key=lambda r: (r[2], r[1])):
        if k not in state or t >= state[k][0] + 36:
            state[k] = (t, 0)
        state[k] = (state[k][0], state[k][1] + 1)
        want_quota[i] = (*state[k], state[k][1] <= 4)
        held = k in lease and lease[k][1] >= t
        if rel:
            want_lease[i] = "released" if held else "none"
            lease.pop(k, None)
        elif held and lease[k][0] != owner:
            want_lease[i] = "refused"
        else:
            want_lease[i] = "extended" if held else "claimed"
            lease[k] = (owner, t + 25)
    for width in (7, HOUR):
        got = gates.quota(frame, "k", limit=4, hours=1e-8, width=width)
        assert {r.id: (r.window_start, r.place, r.allowed) for r in got.collect()} == want_quota
        got = gates.leases(frame, "k", "owner", F.col("rel"), ttl=25, width=width)
        assert {r.id: r.outcome for r in got.collect()} == want_lease
    assert gates.quota(frame.limit(0), "k").count() == gates.leases(frame.limit(0), "k", "owner", F.col("rel")).count() == 0


@pytest.mark.parametrize("name", ["leases", "quota_access"])
def test_gates_read_their_rows_a_few_times(spark, name):
    """Two reads of the rows and two of their numbers by key, in a plan that starts no job of its own."""
    group = f"build {name}"
    spark.sparkContext.setJobGroup(group, group)
    rows = q.QUERIES[name](spark, SF).select("client_id", "click_id")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    # one job reads the schema of the file
    assert jobs <= 1 and plan.count("FileScan parquet") <= 4 and plan.count("Join") <= 2


def test_keys_of_many_rows_are_cut(spark, monkeypatch):
    """A hot key in cells of about 20 rows gives what it gives whole, from claims of many owners with and without releases."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.choice([rng.randrange(60), rng.randrange(5000)]), rng.choice("uvwxyz"), k > 0 and rng.random() < 0.2) for k in range(2) for i in range(600)]
    frame = spark.createDataFrame([(f"{k}{i % 2}", j, t, o, r and i % 2 > 0) for j, (i, (k, _, t, o, r)) in enumerate(enumerate(rows))], "k string, id long, t long, owner string, rel boolean")
    make = lambda: (gates.quota(frame, "k", limit=4, hours=1e-8), gates.leases(frame, "k", "owner", F.col("rel"), ttl=25))
    whole = [sorted(map(tuple, df.collect())) for df in make()]
    monkeypatch.setattr(ordered, "CELL_ROWS", 20)
    assert [sorted(map(tuple, df.collect())) for df in make()] == whole
    assert all(len(w) == len(rows) for w in whole)


@pytest.mark.parametrize("width", [2, 7, 1024])
def test_queues_fold_in_levels(spark, width):
    rng = random.Random(width)
    ops = [("one" if rng.random() < 0.7 else "two", i, rng.choice(["next", "next", "pause", "complete", "fail", "other", None])) for i in range(400)]
    frame = spark.createDataFrame(ops, "queue string, seq long, op string")
    tasks = [(name, place) for name in ("one", "two", "idle") for place in range(60)]
    status, index, paused = {t: "pending" for t in tasks}, {}, {}
    for name, _, op in ops:
        i = index.setdefault(name, 0)
        if op == "next" and paused.pop(name, None) is None:
            while i < 60 and status[name, i] != "pending":
                i += 1
            if i < 60:
                status[name, i] = "running"
            index[name] = i
        elif op in ("pause", "complete", "fail") and i < 60:
            status[name, i] = {"pause": "paused", "complete": "completed", "fail": "failed"}[op]
            if op == "pause":
                paused[name] = True
            else:
                index[name] += 1
    got = gates.queue_state(spark.createDataFrame(tasks, "queue string, place long"), frame, "queue", width=width).collect()
    assert {(r.queue, r.place): (r.status, r.current) for r in got} == {t: (s, t[1] == index.get(t[0], 0)) for t, s in status.items()}


def fed(spark, rows, folder, parts):
    """A stream of rows in order of t and id, a file a micro-batch."""
    edges = rows.approxQuantile("t", [i / parts for i in range(1, parts)], 0)
    for i, (a, b) in enumerate(zip([None, *edges], [*edges, None])):
        some = rows.where(f"{f't >= {a}' if a is not None else 'true'} and {f't < {b}' if b is not None else 'true'}")
        some.coalesce(1).write.parquet(f"{folder}/{i:03d}")
        os.utime(glob.glob(f"{folder}/{i:03d}/part-*")[0], (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def told(out, folder, name, spark):
    """The stream's rows, gathered in two starts on one checkpoint."""
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/at").option("path", f"{folder}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/{name}").collect()


def test_streamed_quota_and_leases_equal_the_batch_form(spark, tmp_path, rocks):
    rows = q.claims(spark, SF).withColumnRenamed("click_id", "id").withColumn("ts", F.timestamp_micros("t"))
    a = fed(spark, rows, f"{tmp_path}/in", 4).withWatermark("ts", "1 second")
    got = told(stateful.quota(a, "client_id", q.CALLS, q.WINDOW), f"{tmp_path}/q", "out", spark)
    assert sorted(map(tuple, got)) == sorted(map(tuple, gates.quota(rows, "client_id", limit=q.CALLS, hours=q.WINDOW).select("client_id", "id", "window_start", "place", "allowed").collect()))
    got = told(stateful.leases(a, "client_id", q.LEASE * HOUR), f"{tmp_path}/l", "out", spark)
    assert sorted(map(tuple, got)) == sorted(map(tuple, gates.leases(rows, "client_id", "owner", F.col("release"), ttl=q.LEASE * HOUR).select("client_id", "id", "outcome").collect()))


def test_streamed_dispatch_queues_and_credit_equal_the_batch_form(spark, tmp_path, rocks):
    runs = q.runs(spark, SF).withColumnRenamed("event_id", "id").withColumns({"task": F.col("task").cast("string"), "owner": F.col("owner").cast("string")})
    how = {"budget": q.BUDGET, "ttl": q.HELD * 1_000_000, "max_age": q.AGE * 1_000_000}
    got = told(stateful.dispatch(fed(spark, runs, f"{tmp_path}/runs", 3), "queue", **how), f"{tmp_path}/d", "out", spark)
    assert sorted(map(tuple, got)) == sorted(map(tuple, gates.dispatch(runs, "queue", **how).collect()))
    ops = q.queue_ops(spark, SF).select("queue", F.col("seq").alias("id"), F.col("seq").alias("t"), "op")
    got = told(stateful.queue_steps(fed(spark, ops, f"{tmp_path}/ops", 3), "queue"), f"{tmp_path}/s", "out", spark)
    assert sorted(map(tuple, got)) == sorted(map(tuple, gates.queue_steps(ops.withColumnRenamed("id", "seq"), "queue").collect()))
    outcomes = q.table(spark, SF, "events").select(F.col("event_type").alias("agent_set"), F.col("event_id").alias("id"), F.col("event_id").alias("t"), (F.col("value") - 35).alias("outcome"))
    got = told(stateful.credit(fed(spark, outcomes, f"{tmp_path}/out", 3), "agent_set"), f"{tmp_path}/c", "out", spark)
    last = {}
    for r in sorted(got, key=lambda r: r.id):
        last[r.agent_set] = r
    want = decide.credit(outcomes.withColumnRenamed("id", "seq")).collect()
    assert len(got) == outcomes.count() and len(want) == len(last)
    for r in want:
        own = last[r.agent_set]
        assert (own.builder, own.critic) == (pytest.approx(r.builder), pytest.approx(r.critic)) and own.history == pytest.approx(r.history)


def test_bounded_log_survives_replays(spark, tmp_path):
    events = q.table(spark, SF, "events").select("user_id", "ts", "event_id")
    want = sorted(map(tuple, control.recent(events, "user_id", ["ts", "event_id"], 3).collect()))
    log = stateful.BoundedLog(f"{tmp_path}/log", "user_id", ["ts", "event_id"], 3)
    assert log.read(spark) is None
    parts = [events.where(f"event_id % 4 = {i}") for i in range(4)]
    for i, part in enumerate(parts):
        log.merge(part, i)
        log.merge(part, i)  # replayed
    log.merge(parts[1].unionByName(parts[1]), 4)  # repeated rows
    assert sorted(map(tuple, log.read(spark).collect())) == want and len(log.versions(spark)) == 2
    os.remove(f"{tmp_path}/log/batch-4/_SUCCESS")  # a torn version does not count
    assert sorted(map(tuple, log.read(spark).collect())) == want
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    second = stateful.BoundedLog(f"{tmp_path}/second", "user_id", ["ts", "event_id"], 3)
    stream.writeStream.foreachBatch(second.merge).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, second.read(spark).collect())) == want


def test_running_values_and_orbits(spark):
    rows = spark.createDataFrame([("a", i, None if i % 3 else i) for i in range(50)], "k string, t long, v long")
    for width in (1, 7, 1000):
        got = ordered.running(rows, ["k"], ["t"], F.col("v"), "x", width, own=False)
        assert {r.t: r.x for r in got.collect()} == {i: (i - 1) // 3 * 3 if i else None for i in range(50)}
    hops = rows.select("k", F.col("t").alias("_at"), F.when(F.col("t") < 45, F.col("t") + 5).alias("_nxt"))
    assert sorted(r[1] for r in ordered.orbit(hops, rows.where("t = 2").select("k", F.col("t").alias("_at")), ["k"]).collect()) == list(range(2, 50, 5))
