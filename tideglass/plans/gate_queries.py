"""Queries of quotas, leases, dispatch and queues over the event tables, with their DuckDB SQL (recursions over each key's rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.operators import gates
from tideglass.operators.ordered import HOUR
from tideglass.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Settings of the queries: calls a window, hours of a window, hours of a lease; runs at once, seconds of a lease and of a run.
CALLS, WINDOW, LEASE = 3, 5, 6
BUDGET, HELD, AGE = 4, 30000, 100000


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn

    return add


def calls(spark, d) -> DataFrame:
    """Clicks as calls of clients: a repeated click is one call; broken ones without client or instant are none."""
    rows = table(spark, d, "clicks").select("client_id", "click_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "kind")
    return rows.where("client_id is not null and click_id is not null and t is not null").groupBy("client_id", "click_id", "t").agg(F.min("kind").alias("kind"))


_CALLS = "c as materialized (select client_id, click_id, epoch_us(ts) as t, min(kind) as kind from clicks where client_id is not null and click_id is not null and ts is not null group by all)"


@query(
    "quota_access",
    f"""with recursive {_CALLS},
w(client_id, s) as (select client_id, min(t) from c group by 1 union all select w.client_id, min(c.t) from w join c on c.client_id = w.client_id and c.t >= w.s + {WINDOW * HOUR} group by w.client_id, w.s),
a as (select c.*, w.s from c asof join w on c.client_id = w.client_id and c.t >= w.s)
select client_id, click_id, t, s as window_start, row_number() over (partition by client_id, s order by t, click_id) as place, row_number() over (partition by client_id, s order by t, click_id) <= {CALLS} as allowed from a""",
)
def quota_access(spark, d):
    found = gates.quota(calls(spark, d), "client_id", tie="click_id", limit=CALLS, hours=WINDOW)
    return found.select("client_id", "click_id", "t", "window_start", "place", "allowed")


def claims(spark, d) -> DataFrame:
    """Clicks as claims of three owners for the client's lease; a purchase or an error is a release."""
    return calls(spark, d).withColumns({"owner": (F.col("click_id") % 3).cast("string"), "release": F.coalesce(F.col("kind").isin("purchase", "error"), F.lit(False))})


@query(
    "leases",
    f"""with recursive {_CALLS},
k as materialized (select client_id, click_id, t, click_id % 3 as o, coalesce(kind in ('purchase', 'error'), false) as rel, row_number() over (partition by client_id order by t, click_id) as k from c),
f(client_id, k, click_id, outcome, held, until) as (
  select client_id, k, click_id, case when rel then 'none' else 'claimed' end, case when not rel then o end, case when not rel then t + {LEASE * HOUR} end from k where k = 1
  union all
  select k.client_id, k.k, k.click_id,
    case when rel and f.until >= t then 'released' when rel then 'none' when f.until >= t and f.held = o then 'extended' when f.until >= t then 'refused' else 'claimed' end,
    case when rel then null when f.until >= t then f.held else o end,
    case when rel then null when f.until >= t and f.held <> o then f.until else t + {LEASE * HOUR} end
  from f join k on k.client_id = f.client_id and k.k = f.k + 1)
select client_id, click_id, outcome from f""",
)
def leases(spark, d):
    return gates.leases(claims(spark, d), "client_id", "owner", F.col("release"), tie="click_id", ttl=LEASE * HOUR).select("client_id", "click_id", "outcome")


def runs(spark, d) -> DataFrame:
    """Events as runs of five queues, 40 tasks and three owners; the value tells how long one runs, every seventh never ends."""
    t, i = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")
    ended = F.when(i % 7 > 0, t + F.floor(F.col("value") * 1000).cast("long") * 1_000_000)
    return table(spark, d, "events").select(F.col("event_type").alias("queue"), "event_id", (F.col("user_id") % 40).alias("task"), (i % 3).alias("owner"), t.alias("t"), ended.alias("ended"), (i % 5 == 0).alias("failed"), (i % 11 == 0).alias("cancelled"))


_RUNS = """r as materialized (
  select event_type as queue, event_id, user_id % 40 as task, event_id % 3 as o, epoch_us(ts) as t, row_number() over (partition by {by} order by epoch_us(ts), event_id) as k, {by} as g,
    case when event_id % 7 > 0 then epoch_us(ts) + floor(value * 1000)::bigint * 1000000 end as ended, event_id % 5 = 0 as failed, event_id % 11 = 0 as cancelled from events),
x as materialized (select *, least(coalesce(ended, t + {age}), t + {age}) as e, case when cancelled or coalesce(ended > t + {age}, true) then 'interrupted' when failed then 'failed' else 'success' end as res from r),
d(g, k, event_id, outcome, active, held) as (
  select g, 0::bigint, null::bigint, null::varchar, []::struct(task bigint, e bigint)[], []::struct(task bigint, o bigint, u bigint)[] from (select distinct g from x)
  union all
  select g, k, event_id, coalesce(why, res), case when why is null then list_append(active, {{'task': task, 'e': e}}) else active end,
    case when why is null then list_append(list_filter(held, lambda h: h.task <> task), {{'task': task, 'o': o, 'u': t + {ttl}}}) else held end
  from (select *, case when {full} then 'no_budget' when len(list_filter(held, lambda h: h.task = task and h.o <> o and h.u >= t)) > 0 then 'skip' end as why
    from (select x.*, list_filter(d.active, lambda a: a.e > x.t) as active, list_filter(d.held, lambda h: not list_contains(list_transform(list_filter(d.active, lambda a: a.e <= x.t), lambda a: a.task), h.task)) as held
      from d join x on x.g = d.g and x.k = d.k + 1)))"""


def _runs_sql(by: str, full: str) -> str:
    return _RUNS.format(by=by, full=full, ttl=HELD * 1_000_000, age=AGE * 1_000_000)


@query("dispatch_outcomes", f"with recursive {_runs_sql('event_type', f'len(active) >= {BUDGET}')} select g as queue, event_id, outcome from d where k > 0")
def dispatch_outcomes(spark, d):
    return gates.dispatch(runs(spark, d), "queue", tie="event_id", budget=BUDGET, ttl=HELD * 1_000_000, max_age=AGE * 1_000_000)


@query("lease_outcomes", f"with recursive {_runs_sql('user_id % 40', 'false')} select event_id, outcome from d where k > 0")
def lease_outcomes(spark, d):
    """Runs of a task under its lease alone, without a budget."""
    rows = runs(spark, d).withColumn("line", F.col("task"))
    return gates.dispatch(rows, "line", tie="event_id", budget=None, ttl=HELD * 1_000_000, max_age=AGE * 1_000_000).select("event_id", "outcome")


def queue_ops(spark, d) -> DataFrame:
    """Events as what is done to five queues: half of them takes the next task, others complete, pause or fail the current one."""
    n = F.col("event_id") % 8
    op = F.when(n < 4, "next").when(n < 6, "complete").when(n == 6, "pause").when(F.col("value") > 5, "fail")
    return table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), op.alias("op"))


@query(
    "queue_transitions",
    """with recursive o as materialized (select event_type as q, event_id as seq, case when event_id % 8 < 4 then 'next' when event_id % 8 < 6 then 'complete' when event_id % 8 = 6 then 'pause' when value > 5 then 'fail' end as op, row_number() over (partition by event_type order by event_id) as k from events),
tasks as materialized (select ['click', 'error', 'purchase', 'signup', 'view'][o_orderkey % 5 + 1] as q, o_orderkey, row_number() over (partition by o_orderkey % 5 order by o_orderkey) - 1 as place from orders),
sizes as materialized (select q, count(*) as n from tasks group by q),
f(q, k, i, now, flag, place, status) as (
  select q, 0::bigint, 0::bigint, 'pending', false, null::bigint, null::varchar from sizes
  union all
  select q, k, case when op in ('complete', 'fail') and i < n then i + 1 when op = 'next' and not flag and i < n and now <> 'pending' then i + 1 else i end,
    case when i >= n then now when op in ('complete', 'fail') then 'pending' when op = 'pause' then 'paused' when op = 'next' and not flag then 'running' else now end,
    case when op = 'next' then false when op = 'pause' and i < n then true else flag end,
    case when i >= n or op is null or (op = 'next' and flag) then null when op = 'next' and now <> 'pending' then i + 1 else i end,
    case when i >= n or (op = 'next' and flag) then null when op = 'next' then 'running' when op = 'pause' then 'paused' when op = 'complete' then 'completed' when op = 'fail' then 'failed' end
  from (select f.q, o.k, f.i, f.now, f.flag, o.op, s.n from f join o on o.q = f.q and o.k = f.k + 1 join sizes s on s.q = f.q)),
st as (select q, place, arg_max(status, k) as status from f where status is not null group by all), ix as (select q, max(i) as i from f group by q)
select tasks.q as queue, o_orderkey, coalesce(status, 'pending') as status, tasks.place = coalesce(ix.i, 0) as current from tasks left join st on st.q = tasks.q and st.place = tasks.place left join ix on ix.q = tasks.q""",
)
def queue_transitions(spark, d):
    from tideglass.operators.ordered import running

    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    tasks = table(spark, d, "orders").select(F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("queue"), "o_orderkey")
    tasks = running(tasks, ["queue"], ["o_orderkey"], F.lit(1), "place", 100_000, how="sum").withColumn("place", F.col("place") - 1)
    found = gates.queue_state(tasks, queue_ops(spark, d), "queue")
    return found.select("queue", "o_orderkey", "status", "current")
