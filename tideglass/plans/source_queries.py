"""Queries that write files and read them back: price files of which one is broken, checkpoints saved, edited and applied.

They use a new folder under spark.checkpoint.dir at every call and leave it there, so they have no SQL; tests hold them against plain Python.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import control
from tideglass.plans.panel_queries import dated
from tideglass.sources import commits, price_files
from tideglass.sources.scratch import new_folder
from tideglass.sources.tables import daily_panel, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, d: dated(fn(spark, d))
    return fn


@query
def failing_sources(spark, d):
    """The price panel of six assets from files, of which the second cannot be read, with an asset that has no file."""
    folder = new_folder(spark, "prices")
    files = price_files.export(daily_panel(spark, d, by_status=True), folder)
    broken = spark._jvm.org.apache.hadoop.fs.Path(f"{files[1][1]}/zz-broken.csv")
    out = broken.getFileSystem(spark._jsc.hadoopConfiguration()).create(broken, True)
    out.write(bytearray(b"\xff\xfe not a table"))
    out.close()
    names = [a for a, _ in files]
    found = price_files.load(spark, [*files, ("gone", f"{folder}/asset=gone")], wait=0.05)
    return price_files.wide(found, [*names, "gone"])


def task_states(spark, d):
    """A task a user: its state after the user's events."""
    last = control.recent(table(spark, d, "events"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "value", "event_type")
    own = last.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("kind"), F.max_by("value", "event_id").alias("v"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x.value).alias("h"), F.count("*").alias("n"))
    status = F.when(F.col("kind") == "error", "failed").when(F.col("kind") == "purchase", "completed").when(F.col("kind") == "view", None).otherwise("running")
    return own.select(
        F.col("user_id").alias("id"), F.concat(F.lit("L"), F.col("user_id") % 3).alias("level"), status.alias("status"),
        F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4).cast("int").alias("current_strategy_index"), F.col("v").alias("current_completion"), F.col("h").alias("completion_history"), F.col("n").cast("int").alias("budget_used"),
    )


@query
def checkpoint_restore(spark, d):
    """Task states saved, the live ones reset, some dropped and others added, the checkpoint applied; with the quota, index and log that came back."""
    path, events = new_folder(spark, "checkpoints"), table(spark, d, "events")
    states = task_states(spark, d)
    used = events.count()
    facts = {"framework_state": "running", "current_task_id": "7", "quota_remaining": max(0, 1000 - used), "quota_total_used": used, "quota_next_refresh": 18000.0, "current_index": 3}
    log = events.select("ts", "event_id", "event_type", "value")
    commits.commit(spark, path, {"tasks": states, "log": commits.tail(log.limit(0), ["ts", "event_id"])}, {})
    commits.commit(spark, path, {"tasks": states, "log": commits.tail(log, ["ts", "event_id"])}, facts, base=1)
    version, back, tables = commits.restore(spark, path)
    fresh = states.where("id % 5 > 0").unionByName(states.select((F.col("id") + 1_000_000).alias("id"), *states.columns[1:]))
    fresh = fresh.withColumns({"status": F.lit("pending"), "current_strategy_index": F.lit(9), "current_completion": F.lit(-1.0), "completion_history": F.array(F.lit(-1.0)), "budget_used": F.lit(-1)})
    defaults = {"status": None, "current_strategy_index": F.lit(0), "current_completion": F.lit(0.0), "completion_history": F.array().cast("array<double>"), "budget_used": F.lit(0)}
    rows = commits.merged(fresh, tables["tasks"], "id", defaults)
    kept = tables["log"].agg(F.count("*").alias("n_log"), F.min("event_id").alias("first_log"), F.max("event_id").alias("last_log"))
    rows = rows.withColumns({"version": F.lit(version), **{k: F.lit(v) for k, v in back.items()}})
    return rows.join(F.broadcast(kept), F.lit(True)).withColumn("completion_history", F.to_json("completion_history"))
