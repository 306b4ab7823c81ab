"""Queries over the price panel, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.stats import trade_cost
from tideglass.operators import backtest, features, metrics, overfit, panel, regime, schedule, strategies
from tideglass.sources.scratch import cut
from tideglass.sources.tables import daily_panel

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_DAY = "day as (select l_shipdate::date as dt, l_returnflag as asset, avg(l_extendedprice / l_quantity) as p, round(sum(l_extendedprice), 4) as volume from lineitem group by all)"
_SMOOTH = "panel as materialized (select dt, asset, round(avg(p) over (partition by asset order by dt rows between 27 preceding and current row), 6) as price, volume from day)"
_FULL = "full_ as materialized (select * from panel where dt in (select dt from panel group by dt having count(*) = (select count(distinct asset) from panel)))"
_RETS = "rets as materialized (select * from (select dt, asset, price / lag(price) over (partition by asset order by dt) - 1 as ret from full_) where ret is not null)"
_PORT = "port as materialized (select dt, avg(ret) as ret from rets group by dt)"
_BASE = f"{_DAY}, {_SMOOTH}, {_FULL}, {_RETS}, {_PORT}"
_DD = "cum as (select dt, ret, exp(sum(ln(1 + ret)) over (order by dt)) as c from port), dd as materialized (select dt, ret, c, round(c / max(c) over (order by dt) - 1, 12) as dd from cum)"


def _rets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.returns(daily_panel(spark, sf_dir))


def _port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.series(panel.portfolio(_rets(spark, sf_dir)))


def _r(c, n: int = 8):
    return F.round(c, n).alias(c) if isinstance(c, str) else F.round(c, n)


_DATES = ("dt", "train_end", "test_start", "test_end", "first_dt", "last_dt", "embargo_start", "embargo_end", "fit_start", "fit_end", "compute_date", "apply_date")


def dated(df: DataFrame) -> DataFrame:
    """Dates as text, which both engines print alike."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query; `dates` are the columns its SQL gives as dates."""

    def add(fn):
        QUERIES[name] = lambda spark, d: dated(fn(spark, d))
        if sql:
            replace = ", ".join(f"strftime({c}::date, '%Y-%m-%d') as {c}" for c in dates)
            ORACLE_SQL[name] = f"select * replace ({replace}) from ({sql})" if dates else sql
        return fn

    return add


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete panel, kept in memory and on disk for plans that read it many times: dates x assets rows."""
    return panel.complete(daily_panel(spark, sf_dir)).persist()


@query("panel_build", f"with {_DAY}, {_SMOOTH} select dt, asset, price from panel", dates=("dt",))
def panel_build(spark, d):
    return daily_panel(spark, d).select("dt", "asset", "price")


@query("returns", f"with {_BASE} select dt, asset, round(ret, 8) as ret from rets", dates=("dt",))
def returns(spark, d):
    return _rets(spark, d).select("dt", "asset", _r("ret"))


@query("portfolio_eq", f"with {_BASE} select dt, round(ret, 8) as ret from port", dates=("dt",))
def portfolio_eq(spark, d):
    return _port(spark, d).select("dt", _r("ret"))


_STATS = "st as (select count(*) as n, 252.0 as ann, exp(sum(ln(1 + ret))) - 1 as tr, avg(ret) as m, stddev_samp(ret) as sd from port), an as (select *, pow(1 + tr, ann / n) - 1 as ar, sd * sqrt(ann) as vol from st)"


@query(
    "metrics_basic",
    f"with {_BASE}, {_DD}, {_STATS} select n, round(tr, 6) as total_return, round(ar, 6) as annual_return, round(vol, 6) as volatility, round((ar - 0.02) / vol, 6) as sharpe, round((select min(dd) from dd), 6) as max_drawdown from an",
)
def metrics_basic(spark, d):
    rows = metrics.record(_port(spark, d))
    return rows.select("n", *[_r(c, 6) for c in ("total_return", "annual_return", "volatility", "sharpe", "max_drawdown")])


_ISLAND = "isl as (select dt, dd, sum((dd = 0)::int) over (order by dt) as island, lead(dt) over (order by dt) is null as is_last from dd), spell as (select island, count(*) filter (dd < 0) as k, bool_or(is_last and dd < 0) as is_open from isl group by island)"


@query(
    "metrics_full",
    f"""with {_BASE}, {_DD}, {_STATS}, {_ISLAND},
q as (select quantile_cont(ret, 0.05) as v, stddev_samp(ret) filter (ret < 0) as ls, sum(ret) filter (ret > 0) as ws, sum(ret) filter (ret < 0) as lo, count(*) filter (ret > 0) as wins, skewness(ret) as g1, kurtosis(ret) + 3 as g2 from port),
w as (select least(252, n // 2) as w from st),
roll as (select avg(case when s > 0 then m / s * sqrt(252) else 0 end) as rs from (select i, avg(ret) over (order by i rows between 251 preceding and current row) as m, stddev_pop(ret) over (order by i rows between 251 preceding and current row) as s from (select ret, row_number() over (order by dt) as i from port)) where i >= 252),
e as (select *, (m * ann - 0.02) / vol as mid, (ar - 0.02) / vol as sh from an, q),
ci as (select *, sqrt(greatest((1 + 0.5 * mid * mid - g1 * mid + (g2 - 3) / 4 * mid * mid) / greatest(n / ann, 1), 1e-10)) as se,
  sqrt(greatest((1 + 0.5 * g1 * sh - 0.25 * (g2 - 3) * sh * sh) / (greatest(n / ann, 1.5) - 1), 1e-10)) as sg from e)
select n, round(tr, 6) as total_return, round(ar, 6) as annual_return, round(vol, 6) as volatility, round(sh, 6) as sharpe,
  round(mid - 1.959963984540054 * se, 6) as sharpe_ci_lower, round(mid + 1.959963984540054 * se, 6) as sharpe_ci_upper,
  round(least(greatest((sh - sg * sqrt(2 * ln(4.0))) / sg, -50), 50), 5) as deflated_sharpe,
  round((ar - 0.02) / (ls * sqrt(ann)), 6) as sortino, round(ar / -(select min(dd) from dd), 6) as calmar, round((select min(dd) from dd), 6) as max_drawdown,
  (select max(k - is_open::int) from spell)::double as max_dd_duration_days, round(wins / n, 6) as win_rate, round(abs(ws / lo), 6) as profit_factor,
  round(ar - 0.02, 6) as excess_return, round(g1, 6) as skewness, round(g2, 6) as kurtosis, round((select rs from roll), 6) as rolling_sharpe_12m,
  round(v, 6) as var_95, round((select avg(ret) from port, q where ret <= v + 1e-15), 6) as cvar_95, round(m, 8) as period_return_mean, round(sd, 8) as period_vol, 'daily' as freq
from ci""",
)
def metrics_full(spark, d):
    return _rounded(metrics.record(_port(spark, d), n_trials=4))


def _rounded(rows: DataFrame, *more: str) -> DataFrame:
    six = ["total_return", "annual_return", "volatility", "sharpe", "sharpe_ci_lower", "sharpe_ci_upper", "sortino", "calmar", "max_drawdown", "win_rate", "profit_factor", "excess_return", "skewness", "kurtosis", "rolling_sharpe_12m", "var_95", "cvar_95"]
    return rows.select("n", *[_r(c, 6) for c in (*six, *more)], _r("deflated_sharpe", 5), "max_dd_duration_days", _r("period_return_mean"), _r("period_vol"), "freq")


def _weekly_sql() -> str:
    """metrics_full over weeks, which are counted as months; one trial, which is not deflated."""
    sql = ORACLE_SQL["metrics_full"]
    for a, b in (
        ("select l_shipdate::date as dt", "select date_trunc('week', l_shipdate)::date as dt"), ("252.0 as ann", "12.0 as ann"), ("least(252, n // 2)", "least(12, n // 2)"), ("251 preceding", "11 preceding"),
        ("i >= 252", "i >= 12"), ("sqrt(252)", "sqrt(12)"), ("'daily'", "'monthly'"), ("least(greatest((sh - sg * sqrt(2 * ln(4.0))) / sg, -50), 50)", "sh"),
    ):
        sql = sql.replace(a, b)
    return sql


@query("metrics_weekly", _weekly_sql())
def metrics_weekly(spark, d):
    rets = panel.returns(daily_panel(spark, d, weekly=True))
    return _rounded(metrics.record(metrics.series(panel.portfolio(rets))))


@query("metrics_by_asset", f"with {_BASE} select asset, count(*) as n, round(exp(sum(ln(1 + ret))) - 1, 6) as total_return, round(stddev_samp(ret) * sqrt(252), 6) as volatility, round(quantile_cont(ret, 0.05), 6) as var_95 from rets group by asset")
def metrics_by_asset(spark, d):
    rows = metrics.record(_rets(spark, d).select(F.col("asset").alias("series_id"), "dt", "ret"))
    return rows.select(F.col("series_id").alias("asset"), "n", *[_r(c, 6) for c in ("total_return", "volatility", "var_95")])


@query("drawdown_curve", f"with {_BASE}, {_DD} select dt, round(c, 8) as cum, round(dd, 8) as dd from dd", dates=("dt",))
def drawdown_curve(spark, d):
    return metrics.drawdowns(_port(spark, d)).select("dt", _r("cum"), _r("dd"))


@query("drawdown_duration", f"with {_BASE}, {_DD}, {_ISLAND} select island::bigint as island, (k - is_open::int)::bigint as rows, is_open from spell where k > 0")
def drawdown_duration(spark, d):
    return metrics.drawdown_durations(metrics.drawdowns(_port(spark, d))).select("island", F.col("rows").cast("long").alias("rows"), "is_open")


@query("rolling_sharpe", f"with {_BASE} select dt, round(case when s > 0 then m / s * sqrt(252) else 0 end, 6) as rolling_sharpe from (select dt, row_number() over (order by dt) as i, avg(ret) over f as m, stddev_pop(ret) over f as s from port window f as (order by dt rows between 251 preceding and current row)) where i >= 252", dates=("dt",))
def rolling_sharpe(spark, d):
    from pyspark.sql import Window as W

    line = W.partitionBy("series_id").orderBy("dt")
    f = line.rowsBetween(-251, 0)
    s = F.stddev_pop("ret").over(f)
    rows = _port(spark, d).withColumn("i", F.row_number().over(line)).withColumn("v", F.when(s > 0, F.avg("ret").over(f) / s * 252**0.5).otherwise(0.0))
    return rows.where("i >= 252").select("dt", F.round("v", 6).alias("rolling_sharpe"))


@query("var_cvar", f"with {_BASE}, q as (select asset, quantile_cont(ret, 0.05) as v from rets group by asset) select asset, round(v, 8) as var_95, round(avg(ret) filter (ret <= v + 1e-15), 8) as cvar_95 from rets join q using (asset) group by asset, v")
def var_cvar(spark, d):
    rows = metrics.record(_rets(spark, d).select(F.col("asset").alias("series_id"), "dt", "ret"))
    return rows.select(F.col("series_id").alias("asset"), _r("var_95"), _r("cvar_95"))


@query("extreme_returns", f"with {_DAY}, {_SMOOTH} select dt, asset, round(ret, 8) as ret from (select dt, asset, price / lag(price) over (partition by asset order by dt) - 1 as ret from panel) where abs(ret) > 0.03", dates=("dt",))
def extreme_returns(spark, d):
    return panel.extreme_flags(daily_panel(spark, d), 0.03).select("dt", "asset", _r("ret"))


_HALT = """f as (select dt, asset, p, coalesce(abs(p - lag(p) over (partition by asset order by dt)) < 1e-12, false) as flat from (select dt, asset, round(price / 25) as p from panel)),
g as (select *, sum(case when flat then 0 else 1 end) over (partition by asset order by dt) as island from f),
h as (select dt, asset, p, sum(flat::int) over (partition by asset, island order by dt rows unbounded preceding) as streak from g)"""


@query("halts", f"with {_DAY}, {_SMOOTH}, {_HALT} select dt, asset, streak::bigint as streak, case when streak >= 4 then null else p end as price from h", dates=("dt",))
def halts(spark, d):
    coarse = daily_panel(spark, d).select("dt", "asset", F.round(F.col("price") / 25).alias("price"))
    return panel.halts(coarse).select("dt", "asset", "streak", "price")


_DAY6 = _DAY.replace("l_returnflag as asset", "l_returnflag || l_linestatus as asset")


@query(
    "ffill_limited",
    f"with {_DAY6}, {_SMOOTH}, g as (select d.dt, a.asset, p.price from (select distinct dt from panel) d cross join (select distinct asset from panel) a left join panel p on p.dt = d.dt and p.asset = a.asset) select dt, asset, last_value(price ignore nulls) over (partition by asset order by dt rows between 3 preceding and current row) as price from g", dates=("dt",),
)
def ffill_limited(spark, d):
    return panel.fill_forward(panel.grid(daily_panel(spark, d, by_status=True))).select("dt", "asset", "price")


_BOUNDS = "b as (select asset, greatest(avg(ret) - 5 * stddev_samp(ret), quantile_cont(ret, 0.005)) as lo, least(avg(ret) + 5 * stddev_samp(ret), quantile_cont(ret, 0.995)) as hi from rets group by asset)"


@query("winsorize", f"with {_BASE}, {_BOUNDS} select dt, asset, round(least(greatest(ret, lo), hi), 8) as ret from rets join b using (asset)", dates=("dt",))
def winsorize(spark, d):
    rets = _rets(spark, d)
    rows = rets.join(F.broadcast(panel.winsor_bounds(rets)), "asset")
    return rows.select("dt", "asset", F.round(panel.clip(F.col("ret"), F.col("lo"), F.col("hi")), 8).alias("ret"))


@query(
    "clean_panel",
    f"""with {_DAY6}, {_SMOOTH}, g as (select d.dt, a.asset, p.price from (select distinct dt from panel) d cross join (select distinct asset from panel) a left join panel p on p.dt = d.dt and p.asset = a.asset),
f as (select *, coalesce(abs(price - lag(price) over (partition by asset order by dt)) < 1e-12, false) as flat from g),
i as (select *, sum(case when flat then 0 else 1 end) over (partition by asset order by dt) as island from f),
h as (select dt, asset, case when sum(flat::int) over (partition by asset, island order by dt rows unbounded preceding) >= 4 then null else price end as price from i),
n as (select dt, asset, last_value(price ignore nulls) over (partition by asset order by dt rows between 3 preceding and current row) as price from h),
k as materialized (select * from n where dt in (select dt from n group by dt having count(price) = (select count(distinct asset) from n))),
rets as materialized (select dt, asset, price, price / lag(price) over (partition by asset order by dt) - 1 as ret from k), {_BOUNDS}
select dt, asset, round(first_value(price) over w * exp(coalesce(sum(case when ret is null then null else ln(1 + least(greatest(ret, lo), hi)) end) over w, 0)), 4) as price
from rets join b using (asset) window w as (partition by asset order by dt rows unbounded preceding)""", dates=("dt",),
)
def clean_panel(spark, d):
    return panel.clean(daily_panel(spark, d, by_status=True)).select("dt", "asset", _r("price", 4))


@query("split_tvt", f"with {_DAY}, {_SMOOTH} select dt, asset, case when dt <= date '1996-06-30' - 5 then 'train' when dt > date '1996-06-30' and dt <= date '1997-06-30' then 'val' when dt > date '1997-06-30' + 5 then 'test' end as split from panel", dates=("dt",))
def split_tvt(spark, d):
    return panel.split(daily_panel(spark, d), "1996-06-30", "1997-06-30").select("dt", "asset", "split")


@query("date_slice", f"with {_DAY}, {_SMOOTH} select dt, asset, price from panel where dt between date '1995-01-01' and date '1995-12-31'", dates=("dt",))
def date_slice(spark, d):
    return daily_panel(spark, d).where(F.col("dt").between("1995-01-01", "1995-12-31")).select("dt", "asset", "price")


@query("covariance", f"with {_BASE} select a.asset as asset_i, b.asset as asset_j, round(covar_samp(a.ret, b.ret), 10) as cov, round(corr(a.ret, b.ret), 8) as corr from rets a join rets b using (dt) group by all")
def covariance(spark, d):
    return panel.covariance(_rets(spark, d)).select("asset_i", "asset_j", _r("cov", 10), _r("corr"))


_CORR = "pair as (select a.dt, a.asset as i, b.asset as j, a.ret as x, b.ret as y from rets a join rets b on a.dt = b.dt and a.asset < b.asset), pc as (select dt, case when count(*) over f = 20 then corr(x, y) over f end as c from pair window f as (partition by i, j order by dt rows between 19 preceding and current row)), mc as (select dt, case when count(c) = count(*) then max(c) end as max_corr from pc group by dt)"


@query("max_corr", f"with {_BASE}, {_CORR} select dt, round(max_corr, 6) as max_corr from mc where max_corr is not null", dates=("dt",))
def max_corr(spark, d):
    return features.compute(_rets(spark, d)).select("dt", _r("max_corr", 6))


@query(
    "features",
    f"""with {_BASE}, {_CORR}, m as (select dt, avg(ret) as r, stddev_samp(ret) as spread from rets group by dt),
f as (select dt, r, spread, count(*) over w20 as n, avg(r) over (order by dt rows between 4 preceding and current row) as r5, avg(r) over w20 as r20, stddev_samp(r) over w20 as v from m window w20 as (order by dt rows between 19 preceding and current row))
select dt, round(r, 8) as ret_1d, round(r5, 8) as ret_5d, round(r20, 8) as ret_20d, round(v, 8) as vol_20d, round(max_corr, 6) as max_corr, round(spread, 8) as spread from f join mc using (dt) where n = 20 and max_corr is not null""", dates=("dt",),
)
def features_query(spark, d):
    rows = features.compute(_rets(spark, d))
    return rows.select("dt", *[_r(c) for c in ("ret_1d", "ret_5d", "ret_20d", "vol_20d", "spread")], _r("max_corr", 6))


@query(
    "trend_sentiment",
    f"""with {_DAY}, {_SMOOTH}, m as (select dt, avg(price) as p from panel group by dt),
u as (select dt, row_number() over (order by dt) as i, case when count(*) over l = 200 and avg(p) over s > avg(p) over l then 1.0 else 0.0 end as up from m window s as (order by dt rows between 49 preceding and current row), l as (order by dt rows between 199 preceding and current row))
select dt, round(case when i < 200 then 0.5 else avg(up) over (order by dt rows between 59 preceding and current row) end, 8) as sentiment from u""", dates=("dt",),
)
def trend_sentiment(spark, d):
    return features.trend_sentiment(daily_panel(spark, d)).select("dt", _r("sentiment"))


@query("cost_curve", "with v as (select o_orderkey, o_totalprice as x from orders) select o_orderkey, round(2 * greatest(x * 0.00025, 5) + 2 * x * 2 / 1e4 + x * 0.0005 + x * 0.001 * sqrt(greatest(x / 1e8, 1e-10)), 6) as cost from v")
def cost_curve(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", F.round(trade_cost(F.col("o_totalprice"), F.lit(1e8)), 6).alias("cost"))


_STEPS = """days as materialized (select distinct dt from panel), k as (select unnest(range(0, 100)) as step),
c as (select step, ((select min(dt) from days) + interval 3 year + to_months((step * 3)::int))::date as cand from k),
t as (select step, (select min(dt) from days where dt >= cand) as te from c), s as (select *, (select min(dt) from days where dt > te + 5) as ts from t),
e as (select *, case when ts is null then null else coalesce((select min(dt) from days where dt >= (ts + interval 3 month)::date), (select max(dt) from days)) end as tend from s),
p as (select *, lag(tend) over (order by step) as prev from e),
z as (select *, (select count(*) from days where dt < te - 5 and not coalesce(dt between prev and prev + 10, false)) as n_train, (select count(*) from days where dt between ts and tend) as n_test from p),
steps as materialized (select * from z where step < coalesce((select min(step) from z where te is null or ts is null or n_train < 20 or n_test < 2), 1000))"""
_WF = f"{_DAY}, {_SMOOTH}, {_FULL}, {_STEPS}"


@query("wf_schedule", f"with {_DAY}, {_SMOOTH}, {_STEPS} select step::int as step, te as train_end, ts as test_start, tend as test_end, n_train::int as n_train, n_test::int as n_test from steps", dates=("train_end", "test_start", "test_end",))
def wf_schedule(spark, d):
    return schedule.walk_forward(daily_panel(spark, d)).select("step", "train_end", "test_start", "test_end", "n_train", "n_test")


_MEMBERS = """mem as materialized (select step, 'train' as side, dt, asset, price from full_ join steps on dt < te - 5 and not coalesce(dt between prev and prev + 10, false)
  union all select step, 'test', dt, asset, price from full_ join steps on dt between ts and tend),
mr as materialized (select * from (select step, side, dt, asset, price / lag(price) over (partition by step, side, asset order by dt) - 1 as ret from mem) where ret is not null)"""


@query("wf_membership_counts", f"with {_WF}, {_MEMBERS} select step::int as step, side, count(*) as n, min(dt) as first_dt, max(dt) as last_dt from mem group by step, side", dates=("first_dt", "last_dt",))
def wf_membership_counts(spark, d):
    p = _panel(spark, d)
    rows = schedule.members(p, schedule.walk_forward(p))
    return rows.groupBy("step", "side").agg(F.count("*").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query("wf_embargo_log", f"with {_WF} select step::int as step, prev as embargo_start, prev + 10 as embargo_end, (select count(*) from days where dt between prev and prev + 10 and dt <= te)::int as excluded from steps where prev is not null", dates=("embargo_start", "embargo_end",))
def wf_embargo_log(spark, d):
    p = daily_panel(spark, d)
    return schedule.embargo_log(p, schedule.walk_forward(p))


_TRAIN = "tr as materialized (select step, dt, asset, ret from mr where side = 'train')"
_W = {
    "equal": "select step, asset, 1.0 / count(*) over (partition by step) as w from (select distinct step, asset from tr)",
    "momentum": "select step, asset, case when bool_and(n = 63) over (partition by step) and sum(g) over (partition by step) > 0 then g / sum(g) over (partition by step) else 1.0 / count(*) over (partition by step) end as w from (select step, asset, count(*) as n, greatest(exp(sum(ln(1 + ret))) - 1, 0) as g from (select *, row_number() over (partition by step, asset order by dt desc) as r from tr) where r <= 63 group by step, asset)",
    "risk_parity": "select step, asset, v / sum(v) over (partition by step) as w from (select step, asset, 1 / greatest(stddev_samp(ret), 1e-10) as v from tr group by step, asset)",
    "defensive": "select step, asset, v / sum(v) over (partition by step) as w from (select step, asset, case when row_number() over (partition by step order by asset desc) <= 3 then 2.0 else 1.0 end as v from (select distinct step, asset from tr))",
}


def _train(spark, d):
    p = _panel(spark, d)
    steps = schedule.walk_forward(p)
    return schedule.step_returns(schedule.members(p, steps).where("side = 'train'"))


def _strategy(name: str):
    def run(spark, d):
        return strategies.BUILT_IN[name](_train(spark, d)).select("step", "asset", F.round("w", 8).alias("w"))

    return run


for _name, _short in (("equal", "strat_eq"), ("momentum", "strat_momentum"), ("risk_parity", "strat_invvol"), ("defensive", "strat_defensive")):
    query(_short, f"with {_WF}, {_MEMBERS}, {_TRAIN} select step::int as step, asset, round(w, 8) as w from ({_W[_name]})")(_strategy(_name))


@query("strat_custom", f"with {_WF}, {_MEMBERS}, {_TRAIN} select step::int as step, asset, round(w, 8) as w from ({_W['risk_parity']})")
def strat_custom(spark, d):
    def inverse(r, cov):
        v = 1 / r.std().clip(lower=1e-10)
        return (v / v.sum()).to_numpy()

    return strategies.custom(_train(spark, d), inverse).select("step", "asset", F.round("w", 8).alias("w"))


_TURN = f"wt as materialized ({_W['momentum']}), tu as (select step, sum(abs(w - pw)) as turnover from (select step, asset, w, lag(w) over (partition by asset order by step) as pw from wt) group by step)"


@query("wf_turnover", f"with {_WF}, {_MEMBERS}, {_TRAIN}, {_TURN} select step::int as step, round(turnover, 8) as turnover from tu")
def wf_turnover(spark, d):
    return backtest.turnover(strategies.momentum(_train(spark, d))).select("step", _r("turnover"))


_EQUITY = f"""{_TURN}, pr as materialized (select step, dt, sum(ret * w) as ret from mr join wt using (step, asset) where side = 'test' group by step, dt),
gr as materialized (select step, dt, row_number() over w as seq, exp(sum(ln(1 + ret)) over w) as g from pr window w as (partition by step order by dt rows unbounded preceding)),
sg as materialized (select step, arg_max(g, dt) as growth, turnover from gr join tu using (step) group by step, turnover),
fold(step, start, pv) as (
  select step, 1.0::double, growth from sg where step = 0
  union all
  select s.step, f.pv * (1 - least((2 * greatest(1e6 * f.pv * s.turnover * 0.00025, 5) + 1e6 * f.pv * s.turnover * 0.0009) / (1e6 * f.pv), 0.005)),
    f.pv * (1 - least((2 * greatest(1e6 * f.pv * s.turnover * 0.00025, 5) + 1e6 * f.pv * s.turnover * 0.0009) / (1e6 * f.pv), 0.005)) * s.growth
  from fold f join sg s on s.step = f.step + 1),
eq as materialized (select f.step, 0 as seq, s.ts as dt, f.start as equity from fold f join steps s using (step) where f.step > 0
  union all select f.step, gr.seq, gr.dt, f.start * gr.g from fold f join gr using (step))"""


@query("wf_equity", f"with recursive {_WF}, {_MEMBERS}, {_TRAIN}, {_EQUITY} select step::int as step, seq::int as seq, dt, round(equity, 7) as equity from eq", dates=("dt",))
def wf_equity(spark, d):
    p = _panel(spark, d)
    return backtest.run(p, strategies.momentum)["equity"].select("step", "seq", "dt", _r("equity", 7))


@query("strategy_matrix", f"with recursive {_WF}, {_MEMBERS}, {_TRAIN}, {_EQUITY}, er as (select *, row_number() over (order by step, seq) - 1 as i from (select step, seq, equity / lag(equity) over (order by step, seq) - 1 as ret from eq) where ret is not null), sz as (select count(*) as n, count(*) // (select count(*) from steps) as per from er), cut as (select least(i // per, (select count(*) from steps) - 1) as s, i, per, ret from er, sz) select s::int as strategy_id, (i - s * per)::int as obs, round(ret, 8) as ret from cut where i - s * per < per")
def strategy_matrix(spark, d):
    p = _panel(spark, d)
    res = backtest.run(p, strategies.momentum)
    return backtest.strategy_matrix(res["equity"], res["steps"].count()).select("strategy_id", "obs", _r("ret"))


@query(
    "wf_step_info",
    f"with {_WF}, {_MEMBERS}, {_TRAIN}, wt as materialized ({_W['risk_parity']}), pr as (select step, dt, sum(ret * w) as ret from mr join wt using (step, asset) where side = 'test' group by step, dt) select step::int as step, round(avg(ret), 9) as portfolio_return, ts as test_start, tend as test_end from pr join steps using (step) group by step, ts, tend",
    dates=("test_start", "test_end"),
)
def wf_step_info(spark, d):
    p = _panel(spark, d)
    return backtest.run(p, strategies.risk_parity)["step_info"].withColumn("portfolio_return", _r("portfolio_return", 9))


_CPCV = """dn as (select dt, row_number() over (order by dt) - 1 as i, (select count(*) from (select distinct dt from full_)) // 6 as size from (select distinct dt from full_)),
dg as (select dt, i // size as grp, i % size as k, size from dn where i < size * 6),
pa as (select row_number() over (order by a, b) - 1 as path, a, b from (select unnest(range(0, 6)) as a) cross join (select unnest(range(0, 6)) as b) where a < b),
cm as materialized (select path, dt, case when grp in (a, b) then 'test' else 'train' end as side from dg cross join pa
  where grp in (a, b) or not ((grp - 1 in (a, b) and k >= size - 5) or (grp + 1 in (a, b) and k < 10)))"""


@query("cpcv_splits", f"with {_DAY}, {_SMOOTH}, {_FULL}, {_CPCV} select path::int as path, side, count(*) as n, min(dt) as first_dt, max(dt) as last_dt from cm group by path, side", dates=("first_dt", "last_dt",))
def cpcv_splits(spark, d):
    rows = schedule.cpcv_members(panel.complete(daily_panel(spark, d)))
    return rows.groupBy("path", "side").agg(F.count_distinct("dt").alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


@query(
    "cpcv_sharpe",
    f"with {_DAY}, {_SMOOTH}, {_FULL}, {_CPCV}, cr as (select path, dt, asset, price / lag(price) over (partition by path, asset order by dt) - 1 as ret from full_ join cm using (dt) where side = 'test'), cd as (select path, dt, avg(ret) as ret from cr where ret is not null group by path, dt) select path::int as path, round(avg(ret) / greatest(stddev_samp(ret), 1e-10) * sqrt(252), 6) as sharpe from cd group by path",
)
def cpcv_sharpe(spark, d):
    return backtest.cpcv_sharpes(panel.complete(daily_panel(spark, d)), strategies.equal).select("path", _r("sharpe", 6))


@query("cpcv_distribution", f"with sh as ({ORACLE_SQL['cpcv_sharpe']}) select count(*) as n_paths, round(avg(sharpe), 5) as mean_sharpe, round(median(sharpe), 5) as median_sharpe, round(stddev_pop(sharpe), 5) as std_sharpe, avg((sharpe > 0)::int) as pct_positive from sh")
def cpcv_distribution(spark, d):
    rows = backtest.cpcv_summary(cpcv_sharpe(spark, d))
    return rows.select("n_paths", *[_r(c, 5) for c in ("mean_sharpe", "median_sharpe", "std_sharpe")], "pct_positive")


@query(
    "benchmarks_6040",
    f"""with {_BASE}, sp as (select min(dt) as lo, max(dt) as hi from rets), q as (select (last_day(x::date + interval 2 month))::date as s from (select unnest(generate_series(date_trunc('quarter', lo), date_trunc('quarter', hi), interval 3 month)) as x from sp)),
qe as (select s, coalesce(lead(s) over (order by s), (select hi from sp)) as e from q, sp where s between lo and hi),
pa as (select dt, avg(ret) filter (asset <> 'R') as st, avg(ret) filter (asset = 'R') as bo from rets group by dt)
select 'index_buy_hold' as series, dt, round(ret, 8) as ret from rets where asset = 'A' union all select 'equal_weight', dt, round(ret, 8) from port
union all select 'sixty_forty', dt, round(0.6 * st + 0.4 * bo, 8) from pa join qe on dt between s and e""", dates=("dt",),
)
def benchmarks_6040(spark, d):
    rets = _rets(spark, d)
    return backtest.benchmarks(rets, panel.asset_index(rets)).select("series", "dt", _r("ret"))


def _sweep_sql() -> str:
    """wf_equity of each parameter set with its own purge and step, and the record of its curve."""
    parts = []
    for i, (purge, months) in enumerate((a, b) for a in (3, 5, 10) for b in (1, 3)):
        steps = _WF.replace("te + 5", f"te + {purge}").replace("te - 5", f"te - {purge}").replace("step * 3", f"step * {months}").replace("interval 3 month", f"interval {months} month")
        members = _MEMBERS.replace("te - 5", f"te - {purge}")
        curve = "er as (select row_number() over (order by step, seq) as i, ret from (select step, seq, equity / lag(equity) over (order by step, seq) - 1 as ret from eq) where ret is not null), cu as (select i, exp(sum(ln(1 + ret)) over (order by i)) as c from er), fall as (select min(round(c / m - 1, 12)) as dd from (select c, max(c) over (order by i) as m from cu))"
        value = "count(*) as n, round((pow(exp(sum(ln(1 + ret))), 252.0 / count(*)) - 1.02) / (stddev_samp(ret) * sqrt(252)), 6) as sharpe, round((select dd from fall), 6) as max_drawdown"
        parts.append(f"select * from (with recursive {steps}, {members}, {_TRAIN}, {_EQUITY}, {curve} select {i}::bigint as param_id, {purge}::bigint as purge, {months}::bigint as step_months, {value} from er)")
    return " union all ".join(parts)


@query("sweep", _sweep_sql())
def sweep(spark, d):
    p = cut(panel.complete(daily_panel(spark, d)))
    grid = [{"purge": a, "step_months": b} for a in (3, 5, 10) for b in (1, 3)]
    return backtest.sweep(p, strategies.momentum, grid)


@query("pbo")
def pbo(spark, d):
    return overfit.pbo(strategy_matrix(spark, d))


@query("effective_trials")
def effective_trials(spark, d):
    return overfit.effective_trials(strategy_matrix(spark, d))


@query("regimes")
def regimes(spark, d):
    p = _panel(spark, d)
    steps = schedule.walk_forward(p, step_months=1)
    return regime.select_states(features.compute(panel.returns(p)), steps)
