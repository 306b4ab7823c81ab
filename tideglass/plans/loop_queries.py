"""Queries of the control loop, decisions, audits and sentiment, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.operators import audit, backtest, control, decide, features, panel, sentiment, strategies
from tideglass.plans import panel_queries
from tideglass.plans.panel_queries import _panel, _rets, dated
from tideglass.sources.scratch import cut
from tideglass.sources.tables import daily_panel, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, d: dated(fn(spark, d))
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"


def _count(words, text="t"):
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))"


@query("task_type", f"select conv_id, turn, case when c >= d and c > 0 then 'code' when d > 0 then 'document' else 'qa' end as task_type from (select conv_id, turn, {_count(control.CODE_WORDS)} as c, {_count(control.DOC_WORDS)} as d from (select *, lower(text) as t from conversations))")
def task_type(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", control.task_type(F.col("text")).alias("task_type"))


@query(
    "response_metrics",
    """with b as (select conv_id, turn, case when len(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 200 then 100.0 when len(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 50 then 50.0 else 0.0 end as s,
  len(text) - len(replace(text, '`', '')) >= 2 as code, regexp_matches(lower(text), 'error|failed|fail|exception|traceback') as bad,
  case when contains(text, '#') or contains(text, '**') then 100.0 else 40.0 end as st, least(100.0, len(text) // 4 / 5.0) as e from conversations),
c as (select *, case when code and not bad then 100.0 when code then 50.0 else 100.0 end as k from b)
select conv_id, turn, round((s * 0.4 + st * 0.3 + e * 0.3)::double, 1) as test_pass_rate, round((s * 0.3 + st * 0.4 + k * 0.3)::double, 1) as boundary_coverage, k >= 50 as compile_ok from c""",
)
def response_metrics(spark, d):
    rows = table(spark, d, "conversations")
    m = control.response_metrics(F.col("text"), F.floor(F.length("text") / 4))
    return rows.select("conv_id", "turn", *[v.alias(k) for k, v in m.items()])


_GAIN = "sc as (select event_id, user_id, ts, value, value - lag(value) over (partition by user_id order by event_id) as g0 from events), gn as (select *, coalesce(g0, 100.0) as gain from sc)"
_ACT = f"{_GAIN}, ia as (select *, sum((gain >= 10)::int) over (partition by user_id order by event_id) as island from gn), ra as (select *, sum((gain < 10)::int) over (partition by user_id, island order by event_id rows unbounded preceding) as low_run from ia), ac as (select *, case when gain >= 20 then 'continue' when gain >= 10 then 'continue_low_freq' when gain >= 5 then 'mark_risk' when low_run >= 3 then 'force_stop' else 'switch_strategy' end as action from ra)"


def _actions(spark, d):
    rows = control.gains(table(spark, d, "events"), "user_id", "event_id", "value")
    return control.gain_actions(rows, "user_id", "event_id")


@query("marginal_gain", f"with {_GAIN} select event_id, round(gain, 6) as gain from gn")
def marginal_gain(spark, d):
    return control.gains(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", F.round("gain", 6).alias("gain"))


@query("gain_actions", f"with {_ACT} select event_id, low_run::bigint as low_run, action from ac")
def gain_actions(spark, d):
    return _actions(spark, d).select("event_id", "low_run", "action")


@query("average_gain", "with r as (select *, row_number() over (partition by user_id order by event_id desc) as r from events) select user_id, round(case when count(*) < 2 then 100 else (arg_max(value, event_id) - arg_min(value, event_id)) / (count(*) - 1) end, 6) as average_gain from r where r <= 3 group by user_id")
def average_gain(spark, d):
    rows = control.average_gain(table(spark, d, "events"), "user_id", "event_id", "value")
    return rows.select("user_id", F.round("average_gain", 6).alias("average_gain"))


@query("quota_windows", "select strftime(time_bucket(interval 5 hours, ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as calls, least(count(*), 30) as allowed, greatest(count(*) - 30, 0) as rejected from events group by 1")
def quota_windows(spark, d):
    rows = control.quota_windows(table(spark, d, "events"), limit=30)
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


_CYC = "cy as (select user_id, case event_type when 'error' then 'api_error' when 'signup' then 'force_stop' else event_type end as action from events)"


@query("health_score", f"with {_CYC}, h as (select user_id, count(*) as n, count(*) filter (action = 'api_error') as e, count(*) filter (action = 'force_stop') as f from cy group by user_id) select user_id, n as cycles, e as api_errors, f as force_stops, round(greatest(100 - (e + f) / n * 40 - f / n * 20, 0), 0) as score from h")
def health_score(spark, d):
    action = F.when(F.col("event_type") == "error", "api_error").when(F.col("event_type") == "signup", "force_stop").otherwise(F.col("event_type"))
    rows = control.health(table(spark, d, "events").select("user_id", action.alias("action")), "user_id")
    full = 100 - (F.col("api_errors") + F.col("force_stops")) / F.col("cycles") * 40 - F.col("force_stops") / F.col("cycles") * 20
    return rows.select("user_id", "cycles", "api_errors", "force_stops", F.round(F.greatest(full, F.lit(0.0)), 0).alias("score"))


@query("tuner_snapshot", f"with {_ACT} select user_id, count(*) as n_cycles, round(avg(gain), 9) as avg_marginal_gain, round(avg(value), 9) as avg_completion, round(count(*) filter (action = 'force_stop') / count(*), 9) as force_stop_rate, round(count(*) filter (action = 'switch_strategy') / count(*), 9) as strategy_switch_rate, count(*) filter (action in ('continue', 'continue_low_freq')) as n_tasks_completed from ac group by user_id")
def tuner_snapshot(spark, d):
    rows = _actions(spark, d).select("user_id", F.col("value").alias("completion_score"), F.col("gain").alias("marginal_gain"), "action", F.lit(100).alias("tokens_used"))
    rows = control.tuner_snapshot(rows, "user_id")
    return rows.select("user_id", "n_cycles", *[F.round(c, 9).alias(c) for c in ("avg_marginal_gain", "avg_completion", "force_stop_rate", "strategy_switch_rate")], "n_tasks_completed")


@query("task_scores", "with i as (select user_id, least(value, 100) as s, case event_type when 'click' then 2.0 else 1.0 end as w, event_type = 'purchase' and value < 0.5 as gate from events), t as (select user_id, case when bool_or(gate) then 0 else sum(s * w) / sum(w) end as r from i group by user_id) select user_id, round(r, 4) as score, case when r >= 90 then 'S' when r >= 80 then 'A' when r >= 60 then 'B' else 'F' end as level from t")
def task_scores(spark, d):
    items = table(spark, d, "events").select("user_id", F.least("value", F.lit(100.0)).alias("score"), F.when(F.col("event_type") == "click", 2.0).otherwise(1.0).alias("weight"), F.when(F.col("event_type") == "purchase", "pass_fail").otherwise("range").alias("scoring_mode"), F.lit(0.5).alias("min_score"))
    gate = F.bool_or((F.col("scoring_mode") == "pass_fail") & (F.col("score") < F.col("min_score")))
    raw = F.when(gate, 0.0).otherwise(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"))
    levels = control.weighted_scores(items, "user_id").select("user_id", "level")
    return items.groupBy("user_id").agg(F.round(raw, 4).alias("score")).join(levels, "user_id")


@query("cost_estimate", "select doc_id, greatest(1, (len(text) // 4 + 500) // 1000 + 1)::bigint as calls from documents")
def cost_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", control.cost_estimate(F.length("text"), F.lit(500)).alias("calls"))


@query("search_trigger", f"select conv_id, turn, {_count(control.SEARCH_WORDS)} > 0 as wants_search, array_to_string(list_filter(regexp_split_to_array(trim(t0, ' '), '\\s+'), lambda w: len(w) > 3)[1:5], ' ') as query from (select *, lower(text) as t, text as t0 from conversations)")
def search_trigger(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", control.wants_search(F.col("text")).alias("wants_search"), control.search_query(F.col("text")).alias("query"))


@query("recent_events", "select event_id, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 8")
def recent_events(spark, d):
    return control.recent(table(spark, d, "events"), "user_id", ["ts", "event_id"], 8).select("event_id", "user_id")


_UP, _DOWN = ["the", "tion", "and", "est", "la"], ["thble", "der", "ción", "ver", "none"]


@query("text_sentiment", f"select doc_id, case when p + n = 0 then 0.5 else p / (p + n) end as sentiment, zh from (select doc_id, {_count(_UP)} as p, {_count(_DOWN)} as n, {_count(sentiment.BULLISH)} - {_count(sentiment.BEARISH)} as zh from (select *, text as t from documents))")
def text_sentiment(spark, d):
    text = F.col("text")
    zh = sentiment.hits(text, sentiment.BULLISH) - sentiment.hits(text, sentiment.BEARISH)
    return table(spark, d, "documents").select("doc_id", sentiment.score(text, _UP, _DOWN).alias("sentiment"), zh.cast("long").alias("zh"))


_EG = "r as (select row_number() over (partition by event_type order by event_id) as t, event_type as strategy, value / 1000 as ret from events), s as (select t, strategy, 0.1 * sum(ret) over (partition by strategy order by t) as s from r)"


@query("eg_weights", f"with {_EG} select t::int as t, strategy, round(exp(s) / sum(exp(s)) over (partition by t), 8) as w from s")
def eg_weights(spark, d):
    n = F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))
    rows = table(spark, d, "events").select(n.alias("t"), F.col("event_type").alias("strategy"), (F.col("value") / 1000).alias("ret"))
    return decide.eg_weights(rows).select("t", "strategy", F.round("w", 8).alias("w"))


@query("meta_credit")
def meta_credit(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("agent_set"), F.col("event_id").alias("seq"), (F.col("value") - 35).alias("outcome"))
    return decide.credit(rows)


def _run(spark, d):
    return backtest.run(_panel(spark, d), strategies.momentum)


@query(
    "audits",
    f"""with {panel_queries._WF},
a1 as (select min(date_diff('day', te, ts)) as g from steps),
nx as (select *, lead(ts) over (order by step) as next_start from steps),
a2 as (select count(*) filter (e <> prev) as n from (select prev, lag(tend) over (order by step) as e from steps) where prev is not null)
select 'A1' as check_id, '1A' as phase, g >= 3 as passed, g::varchar as detail from a1
union all select 'A2', '1A', n = 0, n::varchar from a2
union all select 'A5', '1A', coalesce(bool_and(tend < next_start), true), (count(*) filter (tend >= next_start))::varchar from nx where next_start is not null
union all select 'A6', '1A', coalesce(min(date_diff('day', te, next_start)) >= 1, true), min(date_diff('day', te, next_start))::varchar from nx where next_start is not null""",
)
def audits(spark, d):
    return audit.run_audits(_run(spark, d))


@query("decision_cycle")
def decision_cycle(spark, d):
    """Decisions over the whole rule file with the regimes of the fitted model, whose criterion is on record."""
    from tideglass.operators import cycle, regime, schedule

    p = cut(panel.complete(daily_panel(spark, d)))
    rets = panel.returns(p)
    steps = schedule.local(schedule.walk_forward(p))
    train = schedule.step_returns(schedule.members(p, steps).where("side = 'train'"))
    ends = cut(cycle.training_ends(train))
    fitted = regime.select_states(features.compute(rets), ends.withColumnRenamed("decided", "train_end")).select("step", F.col("state").alias("regime"))
    state = cycle.states(p, ends, rets).drop("regime").join(fitted, "step", "left").withColumn("regime", F.coalesce("regime", F.lit(0)))
    found = cycle.run(p, train, steps, rets, state=state, facts={"hmm_bic_recorded": True})
    return found["decisions"].select("step", "asset", "w", "confidence", "verdict")


def _report_sql() -> str:
    """metrics_full over the run's curve, whose rows are numbered as days, with the benchmark, the p value and the turnover."""
    base = panel_queries._BASE
    run = f"{panel_queries._WF}, {panel_queries._MEMBERS}, {panel_queries._TRAIN}, {panel_queries._EQUITY}"
    curve = f"select * from (with recursive {run} select row_number() over (order by step, seq) as dt, ret from (select step, seq, equity / lag(equity) over (order by step, seq) - 1 as ret from eq) where ret is not null)"
    moved = f"select * from (with {panel_queries._WF}, {panel_queries._MEMBERS}, {panel_queries._TRAIN}, {panel_queries._TURN} select avg(coalesce(turnover, 0)) * 252 / 63 as annual_turnover from tu)"
    bench = f"select * from (with {base} select exp(sum(ln(1 + ret)) * 252.0 / count(*)) - 1 as yearly from port)"
    # Simpson's rule for the normal distribution function at x
    x = "(sh - sg * sqrt(2 * ln(4.0))) / sg"
    cdf = f"0.5 + {x} / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow(({x}) * i / 2000, 2) / 2)))"
    head = f"with port as materialized ({curve}), moved as ({moved}), bench as ({bench}), "
    more = f", round(1 - ({cdf}), 6) as dsr_p_value, round(ar - (select yearly from bench), 6) as excess_vs_benchmark, round((select annual_turnover from moved), 6) as annual_turnover\nfrom ci"
    sql = panel_queries.ORACLE_SQL["metrics_full"].replace(f"with {base}, ", head)
    return sql.replace("\nfrom ci", more)


@query("report_summary", _report_sql())
def report_summary(spark, d):
    from tideglass.operators import metrics

    p = cut(panel.complete(daily_panel(spark, d)))
    run = backtest.run(p, strategies.momentum)
    line = cut(backtest.equity_returns(run["equity"]).select(F.lit("run").alias("series_id"), F.expr("date_add(date'1970-01-01', int(seq_no))").alias("dt"), "ret"))
    turn = run["turnover"].agg(F.avg(F.coalesce("turnover", F.lit(0.0))).alias("t")).select(F.round(F.col("t") * 252 / 63, 6).alias("annual_turnover"))
    found = metrics.record(line, n_trials=4, benchmark=panel.portfolio(panel.returns(p)))
    return panel_queries._rounded(found, "dsr_p_value", "excess_vs_benchmark").crossJoin(F.broadcast(turn))
