"""Queries of operators that the other query modules do not reach, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import audit, backtest, control, decide, report, sentiment
from tideglass.plans import loop_queries, panel_queries
from tideglass.plans.panel_queries import dated
from tideglass.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, d: dated(fn(spark, d))
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


_GAIN = loop_queries._GAIN
_LOOP = f"""{_GAIN}, ed as (select *, gain >= 10 or gain < 5 as edge from gn),
sp as (select *, coalesce(sum(edge::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as part from ed),
lo as (select *, case when gain >= 10 then 0 else count(*) over (partition by user_id, part order by event_id rows unbounded preceding) end as low_run from sp)"""


@query(
    "gain_loop",
    f"with {_LOOP} select event_id, low_run::bigint as low_run, case when gain >= 20 then 'continue' when gain >= 10 then 'continue_low_freq' when gain >= 5 then 'mark_risk' when low_run >= 3 then 'force_stop' else 'switch_strategy' end as action from lo",
)
def gain_loop(spark, d):
    rows = control.gains(table(spark, d, "events"), "user_id", "event_id", "value")
    return control.gain_actions(rows, "user_id", "event_id", looped=True).select("event_id", "low_run", "action")


_TUNED = """case when n_cycles < 30 then '' else array_to_string(list_filter([
  case when avg_marginal_gain > 0 and avg_marginal_gain < 10 and 3 < {low} then 'low_gain_threshold=3.0' end,
  case when force_stop_rate > 0.3 and 4 > {stops} then 'consecutive_stop_limit=4.0' end,
  case when avg_completion < 50 and strategy_switch_rate > 0.2 then 'medium_gain_threshold=7.0' end], lambda x: x is not null), ',') end"""


@query(
    "tuning_suggestions",
    f"with s as ({loop_queries.ORACLE_SQL['tuner_snapshot']}) select user_id, {_TUNED.format(low=5, stops=3)} as fresh, {_TUNED.format(low=2, stops=6)} as tuned from s",
)
def tuning_suggestions(spark, d):
    rows = loop_queries.tuner_snapshot(spark, d)
    text = F.array_join(F.transform("suggestions", lambda t: F.concat_ws("=", t.parameter, t.suggested.cast("string"))), ",")
    one = control.tuning_suggestions(rows).select("user_id", text.alias("fresh"))
    return one.join(control.tuning_suggestions(rows, low=2.0, stops=6).select("user_id", text.alias("tuned")), "user_id")


_CYCLES = "cy as (select user_id, ts, event_id, case event_type when 'error' then 'api_error' when 'signup' then 'force_stop' else event_type end as action from events)"
_SCORE = "round_even(greatest(100 - (e + f) / greatest(n, 1) * 40 - f / greatest(n, 1) * 20, 0)::double, 1)"


@query(
    "health_recent",
    f"""with {_CYCLES}, r as (select * from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from cy) where k <= 200),
h as (select user_id, count(*) as n, count(*) filter (action = 'api_error') as e, count(*) filter (action = 'force_stop') as f from r group by user_id),
s as (select *, {_SCORE} as score from h)
select user_id, n as cycles, score, case when score >= 90 then 'S' when score >= 80 then 'A' when score >= 60 then 'B' else 'F' end as level,
  (e > 0)::int + (f > 0)::int + (score < 60)::int as n_suggestions from s""",
)
def health_recent(spark, d):
    action = F.when(F.col("event_type") == "error", "api_error").when(F.col("event_type") == "signup", "force_stop").otherwise(F.col("event_type"))
    cycles = table(spark, d, "events").select("user_id", "ts", "event_id", action.alias("action"))
    rows = control.health(control.recent(cycles, "user_id", ["ts", "event_id"], 200), "user_id")
    return rows.select("user_id", "cycles", "score", "level", F.size("suggestions").alias("n_suggestions"))


@query(
    "item_scores",
    """with i as (select user_id, least(value, 100) as s, case event_type when 'click' then 2.0 else 1.0 end as w, event_type = 'purchase' and value < 0.5 as gate from events),
t as (select user_id, case when bool_or(gate) then 0 else sum(s * w) / sum(w) end as r from i group by user_id)
select user_id, round_even(r::double, 1) as score, case when r >= 90 then 'S' when r >= 80 then 'A' when r >= 60 then 'B' else 'F' end as level from t""",
)
def item_scores(spark, d):
    mode = F.when(F.col("event_type") == "purchase", "pass_fail").otherwise("range")
    weight = F.when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    items = table(spark, d, "events").select("user_id", F.least("value", F.lit(100.0)).alias("score"), weight.alias("weight"), mode.alias("scoring_mode"), F.lit(0.5).alias("min_score"))
    return control.weighted_scores(items, "user_id")


@query("executor_stats", "select event_type, count(*) as calls, count(*) filter (value < 5) as errors, round_even((count(*) filter (value < 5) / count(*) * 100)::double, 1) as error_rate from events group by event_type")
def executor_stats(spark, d):
    return control.executor_stats(table(spark, d, "events").select("event_type", (F.col("value") < 5).alias("is_error")), "event_type")


@query("status_totals", "select case when value < 20 then 'paused' when value < 60 then 'pending' else 'done' end as status, count(*) as tasks from events group by 1")
def status_totals(spark, d):
    status = F.when(F.col("value") < 20, "paused").when(F.col("value") < 60, "pending").otherwise("done")
    return control.status_totals(table(spark, d, "events").select(status.alias("status")))


_CREDIT = "list_reduce(list_prepend(0.5::double, list(case when value > 35 then {a} else {b} end order by event_id)), lambda a, x: least(greatest(a + x, 0.0), 1.0))"


@query(
    "credit_walk",
    f"""select event_type as agent_set, round({_CREDIT.format(a="0.01::double", b="-0.01::double")}, 6) as builder, round({_CREDIT.format(a="-0.01::double", b="0.01::double")}, 6) as critic,
  list(event_id order by event_id)[-8:]::varchar as last_ids from events group by event_type""",
)
def credit_walk(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("agent_set"), F.col("event_id").alias("seq"), (F.col("value") - 35).alias("outcome"))
    walk = decide.credit(rows).select("agent_set", F.round("builder", 6).alias("builder"), F.round("critic", 6).alias("critic"))
    ids = decide.latest(rows, "agent_set", "seq", "seq", 8).select("agent_set", F.concat(F.lit("["), F.array_join("latest", ", "), F.lit("]")).alias("last_ids"))
    return walk.join(ids, "agent_set")


#: What a turn's number adds to its text: the words themselves are the query's subject, and the tables' prose has none of them.
_ADDED = ["", "，".join(sentiment.BULLISH[:3]), sentiment.BEARISH[0] + "!", sentiment.BULLISH[3] + sentiment.BEARISH[1], " ".join(sentiment.BEARISH), "".join(sentiment.BULLISH), sentiment.BULLISH[0] * 3 + sentiment.BEARISH[2]]


@query(
    "keyword_sentiment",
    f"""with s as (select conv_id, turn, {loop_queries._count(sentiment.BULLISH)} as p, {loop_queries._count(sentiment.BEARISH)} as n
  from (select conv_id, turn, coalesce(text, '') || ({loop_queries._list(_ADDED)})[(conv_id + turn) % {len(_ADDED)} + 1] as t from conversations))
select conv_id, turn, case when p + n = 0 then 0.5 else p / (p + n) end as sentiment from s""",
)
def keyword_sentiment(spark, d):
    added = F.element_at(F.array(*map(F.lit, _ADDED)), ((F.col("conv_id") + F.col("turn")) % len(_ADDED) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), added)
    return table(spark, d, "conversations").select("conv_id", "turn", sentiment.score(text).alias("sentiment"))


_FACT_SQL = {
    "stamp_duty": "case when min(value) < 5 then 0.001 else 0.0 end", "commission_rate": "0.0002 + 0.00001 * (count(*) % 12)", "slippage_bps": "case when count(*) % 7 > 0 then count(*) % 7 end",
    "n_steps": "count(*) filter (where event_type = 'view')", "n_strategies": "count(distinct event_type)", "max_weight_corr": "(user_id % 10) / 10.0", "seed_sharpe_std": "coalesce(stddev_pop(value), 0) / 100.0",
    "grid_sharpe_range": "(max(value) - min(value)) / 200.0", "dsr_p_value": "(user_id % 20) / 200.0", "pbo": "count(*) filter (where event_type = 'error') / (count(*) * 0.5)", "sensitivity_done": "max(value) > 80",
    "cpcv_positive": "count(*) filter (where value > 30) / (count(*) * 1.0)", "sharpe": "avg(value) / 12.0",
}
_CHECKS = [
    ("B1", "1B", "stamp_duty > 0 and commission_rate >= 0.00025 and slippage_bps >= 2"), ("B2", "1B", "n_steps >= 3"), ("B3", "1B", "n_strategies >= 2 and max_weight_corr < 0.7"),
    ("B4", "1B", "seed_sharpe_std < 0.3"), ("B5", "1B", "grid_sharpe_range < 0.5"), ("D1", "3", "dsr_p_value < 0.05"), ("D2", "3", "pbo < 0.3"), ("D3", "3", "sensitivity_done"),
    ("D4", "3", "cpcv_positive > 0.5"), ("D5", "3", "sharpe < 2.5"),
]


_FACTS = f"select user_id, {', '.join(f'{e} as {n}' for n, e in _FACT_SQL.items())} from events group by user_id"


@query("quality_audits", f"with f as materialized ({_FACTS}) " + " union all ".join(f"select user_id, '{c}' as check_id, '{p}' as phase, coalesce({e}, false) as passed from f" for c, p, e in _CHECKS))
def quality_audits(spark, d):
    """Each user's events stand for a run: its facts are counted from them."""
    facts = table(spark, d, "events").groupBy("user_id").agg(*[F.expr(e).alias(n) for n, e in _FACT_SQL.items()])
    return audit.quality_audits(facts, keys=("user_id",)).select("user_id", "check_id", "phase", "passed")


@query(
    "fit_audits",
    f"""with {panel_queries._WF}, h as (select te as fit_end, te - 30 as scaler_fit_end from steps), f as (select min(te) as first_end from steps)
select 'A3' as check_id, '1A' as phase, bool_and(fit_end <= first_end) as passed, (count(*) filter (fit_end > first_end))::varchar as detail from h, f
union all select 'A4', '1A', bool_and(scaler_fit_end <= first_end), (count(*) filter (scaler_fit_end > first_end))::varchar from h, f""",
)
def fit_audits(spark, d):
    steps = panel_queries.wf_schedule(spark, d)
    return audit.fit_audits(steps.select(F.col("train_end").alias("fit_end"), F.date_sub("train_end", 30).alias("scaler_fit_end")), steps)


@query("benchmark_cagr", f"select series, count(*) as n, round((exp(sum(ln(1 + ret))) ** (1 / greatest(count(*) / 252.0, 0.5)) - 1) * 100, 4) as cagr_pct from ({panel_queries.ORACLE_SQL['benchmarks_6040']}) group by series")
def benchmark_cagr(spark, d):
    rows = report.cagr(panel_queries.benchmarks_6040(spark, d), "series")
    return rows.select("series", "n", F.round("cagr_pct", 4).alias("cagr_pct"))


_LOG = "lg as (select event_id, case when value < 30 then 'momentum' when value < 60 then 'risk_parity' else 'defensive' end as strategy, case event_type when 'error' then 'REJECT' when 'click' then 'DOWNGRADE' when 'view' then 'N/A' else 'APPROVE' end as verdict from events)"


def _cycle_log(spark, d):
    strategy = F.when(F.col("value") < 30, "momentum").when(F.col("value") < 60, "risk_parity").otherwise("defensive")
    verdict = F.when(F.col("event_type") == "error", "REJECT").when(F.col("event_type") == "click", "DOWNGRADE").when(F.col("event_type") == "view", "N/A").otherwise("APPROVE")
    return table(spark, d, "events").select("event_id", strategy.alias("strategy"), verdict.alias("verdict"))


@query("verdict_counts", f"with {_LOG} select count(*) filter (verdict = 'APPROVE') as approved, count(*) filter (verdict = 'DOWNGRADE') as downgraded, count(*) filter (verdict = 'REJECT') as rejected from lg")
def verdict_counts(spark, d):
    return report.verdict_counts(_cycle_log(spark, d))


@query("strategy_counts", f"with {_LOG}, c as (select strategy, count(*) as quarters from lg group by strategy) select strategy, quarters, round(100 * quarters / sum(quarters) over (), 4) as share_pct, row_number() over (order by quarters desc, strategy)::int as place from c")
def strategy_counts(spark, d):
    return report.strategy_counts(_cycle_log(spark, d)).withColumn("share_pct", F.round("share_pct", 4))


_RECORD_SQL = {"annual_return": "round(avg(value) / 1000 - 0.03, 6)", "deflated_sharpe": "(user_id % 9) / 10.0", "dsr_p_value": "(user_id % 7) / 60.0", "pbo": "count(*) filter (where event_type = 'view') / (count(*) * 1.0)", "n": "count(*) * 8"}
_RECORDS = f"select user_id, {', '.join(f'{e} as {n}' for n, e in _RECORD_SQL.items())} from events group by user_id"


@query(
    "report_notes",
    f"""select user_id, case when annual_return > 0.05 and deflated_sharpe > 0.5 then 'positive' when annual_return > 0 then 'neutral' else 'cautious' end as conclusion,
  array_to_string(list_filter([case when pbo > 0.5 then 'pbo' end, case when n > 0 and n < 756 then 'short_history' end, case when dsr_p_value > 0.05 then 'dsr' end], lambda x: x is not null), ',') as warnings
from ({_RECORDS})""",
)
def report_notes(spark, d):
    """Each user's events stand for a run: its record is made of them."""
    rows = table(spark, d, "events").groupBy("user_id").agg(*[F.expr(e).alias(n) for n, e in _RECORD_SQL.items()])
    return rows.select("user_id", report.conclusion().alias("conclusion"), F.array_join(report.warnings(), ",").alias("warnings"))


@query(
    "cycle_outcomes",
    """with n as (select (select count(*) from events where event_type = 'click') as cycles, (select count(*) from events where event_type <> 'click') as rets),
r as (select row_number() over (order by event_id) - 1 as i, value / 1000 as ret from events where event_type <> 'click')
select c::int as cycle, round(avg(ret), 9) as outcome, count(*) as n from (select i, ret, c from r, n, unnest(range(0, 40)) as u(c) where i >= c * rets // 40 and (i < (c + 1) * rets // 40 or c = 39)) group by c""",
)
def cycle_outcomes(spark, d):
    rets = table(spark, d, "events").where("event_type <> 'click'").select(F.col("event_id").alias("seq_no"), (F.col("value") / 1000).alias("ret"))
    return backtest.cycle_outcomes(rets, 40).withColumn("outcome", F.round("outcome", 9))


@query("queue_view", "with t as (select event_id, case when value < 20 then 'paused' when value < 60 then 'pending' else 'done' end as status from events), r as (select *, case status when 'paused' then 0 when 'pending' then 1 end as k from t) select event_id, case when k is not null then row_number() over (order by k nulls last, event_id) end::int as place from r")
def queue_view(spark, d):
    status = F.when(F.col("value") < 20, "paused").when(F.col("value") < 60, "pending").otherwise("done")
    return control.queue_view(table(spark, d, "events").select("event_id", status.alias("status")), "event_id").select("event_id", "place")


_RUN = f"with recursive {panel_queries._WF}, {panel_queries._MEMBERS}, {panel_queries._TRAIN}, {panel_queries._EQUITY}"


@query(
    "run_metrics",
    f"{_RUN}, er as (select seq_no, ret from (select row_number() over (order by step, seq) as seq_no, equity / lag(equity) over (order by step, seq) - 1 as ret from eq) where ret is not null) select count(*) as n, round(case when stddev_samp(ret) > 0 then avg(ret) / stddev_samp(ret) * sqrt(252) else 0 end, 6) as sharpe, round((exp(sum(ln(1 + ret))) - 1) * 100, 6) as total_return_pct, round(stddev_samp(ret) * sqrt(252) * 100, 6) as volatility_pct from er",
)
def run_metrics(spark, d):
    rets = backtest.equity_returns(loop_queries._run(spark, d)["equity"])
    rows = audit.run_metrics(rets)
    return rows.select("n", *[F.round(c, 6).alias(c) for c in ("sharpe", "total_return_pct", "volatility_pct")])


@query(
    "trust_context",
    f"""{_RUN}, er as (select seq_no, ret from (select row_number() over (order by step, seq) as seq_no, equity / lag(equity) over (order by step, seq) - 1 as ret from eq) where ret is not null)
select (select count(*) from steps) as n_steps, (select count(*) from steps)::int as n_intervals, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) as sharpe, round((exp(sum(ln(1 + ret))) - 1) * 100, 6) as total_return_pct,
  round(stddev_samp(ret) * sqrt(252) * 100, 6) as volatility_pct, round((select min(f) from (select equity / max(equity) over (order by step, seq rows unbounded preceding) - 1 as f from eq)) * 100, 6) as max_drawdown_pct from er""",
)
def trust_context(spark, d):
    rows = audit.trust_context(loop_queries._run(spark, d))
    return rows.select("n_steps", F.size("intervals").alias("n_intervals"), *[F.round(c, 6).alias(c) for c in ("sharpe", "total_return_pct", "volatility_pct", "max_drawdown_pct")])


@query("hybrid_route", f"with {_GAIN} select event_id, case when user_id % 3 = 0 or (user_id % 3 = 1 and value < 30 and gain < 10 and event_id % 4 > 0) then 'judge' else 'rule' end as route from gn")
def hybrid_route(spark, d):
    rows = control.gains(table(spark, d, "events"), "user_id", "event_id", "value")
    task_level = F.element_at(F.array(F.lit("L1"), F.lit("L2"), F.lit("L3")), (F.col("user_id") % 3 + 1).cast("int"))
    return rows.select("event_id", control.hybrid_route(task_level, F.col("value"), F.col("gain"), F.col("event_id") % 4).alias("route"))


_RUNS = "ru as (select event_id, user_id, case event_type when 'click' then 'queued' when 'view' then 'running' else 'success' end as status, case when value >= 1 then value * 20 end as started, null::double as finished from events)"
_SWEPT = f"{_RUNS}, sw as (select * replace (case when status in ('queued', 'running') and 1500.0 - started > 600 then 'interrupted' else status end as status, case when status in ('queued', 'running') and 1500.0 - started > 600 then 1500.0::double else finished end as finished) from ru)"


def _swept(spark, d):
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "running").otherwise("success")
    runs = table(spark, d, "events").select("event_id", "user_id", status.alias("status"), F.when(F.col("value") >= 1, F.col("value") * 20).alias("started"), F.lit(None).cast("double").alias("finished"))
    return control.sweep_stale(runs, 1500.0)


@query("stale_sweep", f"with {_SWEPT} select event_id, status, finished from sw")
def stale_sweep(spark, d):
    return _swept(spark, d).select("event_id", "status", "finished")


@query("run_budget", f"with {_SWEPT} select user_id, count(*) filter (status in ('queued', 'running')) as active, count(*) filter (status in ('queued', 'running')) < 3 as has_budget from sw group by user_id")
def run_budget(spark, d):
    return control.run_budget(_swept(spark, d), "user_id", 3)
