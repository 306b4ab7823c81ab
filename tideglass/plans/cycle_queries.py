"""Queries of whole decision cycles: states, findings, decisions, the adaptive run, its credit and its report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import backtest, checklist, cycle, panel, report, schedule, strategies
from tideglass.plans.panel_queries import _EQUITY, _MEMBERS, _TRAIN, _W, _WF, dated
from tideglass.sources.scratch import cut
from tideglass.sources.tables import daily_panel

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, d: dated(fn(spark, d))
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


_POOL = "pool as materialized (" + " union all ".join(f"select step, '{n}' as strategy, asset, w from ({_W[n]})" for n in strategies.NAMES) + ")"
_STATE = """ends as materialized (select step, max(dt) as decided, count(distinct dt) as n_samples from tr group by step),
mk as (select dt, avg(ret) as m from (select dt, asset, price / lag(price) over (partition by asset order by dt) - 1 as ret from full_) where ret is not null group by dt),
r20 as materialized (select dt, r from (select dt, round(avg(m) over (order by dt rows between 19 preceding and current row), 12) as r, row_number() over (order by dt) as i from mk) where i >= 20),
rg as (select e.step, (4 * count(*) filter (h.r < n.r)) // count(*) as regime from ends e join r20 n on n.dt = e.decided join r20 h on h.dt <= e.decided group by e.step),
mp as (select dt, avg(price) as p from full_ group by dt),
up as (select dt, row_number() over (order by dt) as i, case when count(*) over l = 200 and avg(p) over s > avg(p) over l then 1.0 else 0.0 end as up from mp window s as (order by dt rows between 49 preceding and current row), l as (order by dt rows between 199 preceding and current row)),
md as (select dt, case when i < 200 then 0.5 else avg(up) over (order by dt rows between 59 preceding and current row) end as sentiment from up),
state as materialized (select e.step, coalesce(rg.regime, 0) as regime, coalesce(md.sentiment, 0.5) as sentiment from ends e left join rg using (step) left join md on md.dt = e.decided)"""
_ITEMS = "items as (select * from (values " + ", ".join(f"({i}, '{m}', '{t}')" for i, (m, t) in enumerate(checklist.ITEMS, 1)) + ") v(item_no, marker, t))"
# the rules as one case by marker, the first that holds
_RULED = """case marker
  when 'LOOKAHEAD' then case when contains(t, 'Purging') then date_diff('day', decided, test_start) >= 5 else true end
  when 'SHORT' then case when contains(t, '权重和') then abs(total - 1) < 0.01 when contains(t, '40%') then top <= 0.4 else low >= 0 end
  when 'SPLIT' then case when contains(t, '样本') then n_samples >= 200 else true end
  when 'CLEAN' then case when contains(t, '样本') then n_samples >= 200 else true end
  when 'COST' then case when contains(t, '换手率') then yearly <= 3 else true end
  when 'MODEL_EVAL' then not contains(t, 'BIC')
  when 'OVERFIT' then case when contains(t, 'Deflated Sharpe') then dsr_ok else not contains(t, 'PBO') and not contains(t, '参数敏感性') end
  when 'SNOOPING' then case when contains(t, 'PBO') then false when contains(t, 'Deflated Sharpe') then dsr_ok else true end
  else true end"""
_CYCLE = f"""{_POOL}, {_STATE}, {_ITEMS},
want as (select step, case when regime = 0 or sentiment < 0.3 then 'defensive' when sentiment > 0.6 then 'momentum' else 'risk_parity' end as strategy,
  case when regime = 0 or sentiment < 0.3 then 0.6 when sentiment > 0.6 then 0.8 else 0.7 end as confidence from state),
made as materialized (select step, strategy, confidence, asset, case when s > 0 then c / s else 1.0 / n end as w from (select p.step, p.strategy, confidence, asset, c, sum(c) over (partition by p.step) as s, count(*) over (partition by p.step) as n
  from (select *, least(greatest(w, 0), 0.4) as c from pool) p join want on p.step = want.step and p.strategy = want.strategy)),
tp as (select step, dt, sum(ret * w) as ret from tr join made using (step, asset) group by step, dt),
es as (select step, count(*) as n, exp(sum(ln(1 + ret))) - 1 as total, stddev_samp(ret) * sqrt(252) as vol, skewness(ret) as g1, kurtosis(ret) + 3 as g2 from tp group by step),
eh as (select *, (pow(1 + total, 252.0 / n) - 1.02) / vol as sh from es),
eg as (select *, sqrt(greatest((1 + 0.5 * g1 * sh - 0.25 * (g2 - 3) * sh * sh) / (greatest(n / 252.0, 1.5) - 1), 1e-10)) as sg from eh),
ev as (select step, (sh - sg * sqrt(2 * ln(4.0))) / sg > 1.6448536269514722 as dsr_ok from eg),
mv as (select step, asset, abs(w - lag(w) over (partition by asset order by step)) as move from made),
yr as (select step, coalesce(sum(move), 0) * 4 as yearly from mv group by step),
wt0 as (select step, any_value(strategy) as strategy, any_value(confidence) as confidence, sum(w) as total, max(w) as top, min(w) as low, count(*) as n_assets from made group by step),
ctx as materialized (select step, decided, ts as test_start, n_samples, strategy, confidence, total, top, low, n_assets, yearly, dsr_ok from ends join steps using (step) join wt0 using (step) join yr using (step) join ev using (step)),
found as materialized (select step, item_no, marker, t, {_RULED} as passed from ctx cross join items),
rv as (select step, count(*) as total_checks, count(*) filter (passed) as passed, count(*) filter (not passed) as failed,
  count(*) filter (not passed and (contains(t, '前视偏差') or contains(t, 'Purging') or contains(t, '全局') or contains(t, '过拟合'))) as critical_failures from found group by step),
vd as materialized (select *, case when critical_failures > 0 then 'REJECT' when failed > 0 then 'DOWNGRADE' else 'APPROVE' end as verdict from rv),
dc as materialized (select step, asset, w / sum(w) over (partition by step) as w from (select step, asset, case verdict when 'REJECT' then 1.0 / n_assets when 'DOWNGRADE' then 0.7 * made.w + 0.3 / n_assets else made.w end as w from made join vd using (step) join ctx using (step)))"""
_BASE = f"{_WF}, {_MEMBERS}, {_TRAIN}"
_ADAPT = _EQUITY.replace(f"wt as materialized ({_W['momentum']})", "wt as materialized (select * from dc)")


def _inputs(spark, d):
    """(panel, returns, steps, training returns) of the complete panel, which is written once."""
    p = cut(panel.complete(daily_panel(spark, d)))
    steps = schedule.local(schedule.walk_forward(p))
    train = schedule.step_returns(schedule.members(p, steps).where("side = 'train'"))
    return p, panel.returns(p), steps, train


def _cycles(spark, d):
    p, rets, steps, train = _inputs(spark, d)
    return cycle.run(p, train, steps, rets)


def _adaptive(spark, d):
    """The walk-forward run whose weights are the cycles' decisions: (run's tables, log, panel)."""
    p, rets, steps, train = _inputs(spark, d)
    cycles = cycle.run(p, train, steps, rets)
    return backtest.run(p, lambda _: cycles["weights"]), cycles["log"], p


@query("market_states", f"with {_BASE}, {_STATE} select step::int as step, regime::int as regime, round(sentiment, 8) as sentiment from state")
def market_states(spark, d):
    p, rets, _, train = _inputs(spark, d)
    return cycle.states(p, cycle.training_ends(train), rets).withColumn("sentiment", F.round("sentiment", 8))


@query("decision_findings", f"with {_BASE}, {_CYCLE} select step::int as step, item_no::int as item_no, marker, t as \"check\", passed from found")
def decision_findings(spark, d):
    return _cycles(spark, d)["findings"].drop("confidence")


@query(
    "decision_log",
    f"""with {_BASE}, {_CYCLE} select c.step::int as cycle, strftime(decided::date, '%Y-%m-%d') as decided, strategy, confidence::double as builder_confidence, verdict,
  round(case verdict when 'REJECT' then 0.1 when 'DOWNGRADE' then confidence * 0.6 else confidence * 0.75 end, 6)::double as final_confidence,
  total_checks, passed, failed, critical_failures, '' as fallbacks from ctx c join vd using (step)""",
)
def decision_log(spark, d):
    rows = _cycles(spark, d)["log"]
    return rows.drop("weights").withColumns({"final_confidence": F.round("final_confidence", 6), "fallbacks": F.array_join("fallbacks", ",")})


@query("decision_weights", f"with {_BASE}, {_CYCLE} select step::int as step, asset, round(made.w, 8) as proposed, round(dc.w, 8) as w from made join dc using (step, asset)")
def decision_weights(spark, d):
    return _cycles(spark, d)["decisions"].select("step", "asset", F.round("proposed", 8).alias("proposed"), F.round("w", 8).alias("w"))


@query("adaptive_equity", f"with recursive {_BASE}, {_CYCLE}, {_ADAPT} select step::int as step, seq::int as seq, strftime(dt::date, '%Y-%m-%d') as dt, round(equity, 7) as equity from eq")
def adaptive_equity(spark, d):
    return _adaptive(spark, d)[0]["equity"].select("step", "seq", "dt", F.round("equity", 7).alias("equity"))


@query(
    "cycle_credit",
    f"""with recursive {_BASE}, {_CYCLE}, {_ADAPT},
er as materialized (select row_number() over (order by step, seq) - 1 as i, ret from (select step, seq, equity / lag(equity) over (order by step, seq) - 1 as ret from eq) where ret is not null),
nn as (select (select count(*) from er) as n, (select count(*) from ctx) as k),
oc as materialized (select step, nth, coalesce((select avg(ret) from er where i >= nth * n // k and (i < (nth + 1) * n // k or nth = k - 1)), 0) as outcome from (select step, row_number() over (order by step) - 1 as nth from ctx), nn),
walk(nth, builder, critic) as (select -1::bigint, 0.5::double, 0.5::double union all
  select o.nth, least(greatest(builder + case when outcome > 0 then 0.01 else -0.01 end, 0), 1), least(greatest(critic - case when outcome > 0 then 0.01 else -0.01 end, 0), 1) from walk w join oc o on o.nth = w.nth + 1)
select step::int as cycle, strategy, verdict, round(outcome, 9) as outcome, round(builder, 6) as builder, round(critic, 6) as critic from oc join walk using (nth) join ctx using (step) join vd using (step)""",
)
def cycle_credit(spark, d):
    run, log, _ = _adaptive(spark, d)
    rows = cycle.credited(log, cut(backtest.equity_returns(run["equity"])))
    return rows.select("cycle", "strategy", "verdict", F.round("outcome", 9).alias("outcome"), F.round("builder", 6).alias("builder"), F.round("critic", 6).alias("critic"))


@query("run_report")
def run_report(spark, d):
    """The report of the adaptive run, a row a line; PBO's random splits and the normal distribution keep it out of SQL."""
    run, log, p = _adaptive(spark, d)
    rets = panel.returns(p)
    marks = backtest.benchmarks(rets, panel.asset_index(rets))
    cpcv = backtest.cpcv_summary(backtest.cpcv_sharpes(p, strategies.equal))
    return report.text(report.summary(run, log, panel.portfolio(rets)), log, marks, cpcv)
