"""The closing report: counts over the decision log, benchmark growth, warnings, conclusion, text and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.operators import backtest, metrics, overfit
from tideglass.sources.scratch import cut

#: Periods of a year, and those below which a deflated Sharpe ratio is called unreliable.
YEAR, SHORT = 252, 756


def verdict_counts(log: DataFrame) -> DataFrame:
    """One row (approved, downgraded, rejected) over a decision log with `verdict`; other verdicts count nowhere."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return log.agg(n("APPROVE").alias("approved"), n("DOWNGRADE").alias("downgraded"), n("REJECT").alias("rejected"))


def strategy_counts(log: DataFrame) -> DataFrame:
    """(strategy, quarters, share_pct, place), the most used first; the table has one row a strategy."""
    rows = log.groupBy(F.coalesce("strategy", F.lit("unknown")).alias("strategy")).agg(F.count("*").alias("quarters"))
    all_ = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = F.col("quarters") * 100.0 / F.sum("quarters").over(all_)
    return rows.select("strategy", "quarters", share.alias("share_pct"), F.row_number().over(W.orderBy(F.desc("quarters"), "strategy")).alias("place"))


def cagr(rets: DataFrame, by: str, ret: str = "ret") -> DataFrame:
    """(by, n, cagr_pct): yearly growth of each series in percent, over half a year at least."""
    rows = rets.groupBy(by).agg(F.count(ret).alias("n"), F.exp(F.sum(F.log1p(ret))).alias("grown"))
    years = F.greatest(F.col("n") / YEAR, F.lit(0.5))
    return rows.select(by, "n", F.when(F.col("n") > 0, (F.pow("grown", 1 / years) - 1) * 100).otherwise(0.0).alias("cagr_pct"))


def warnings() -> Column:
    """Over a record with pbo, n and dsr_p_value: which of `pbo`, `short_history` and `dsr` apply."""
    told = F.array(
        F.when(F.col("pbo") > 0.5, "pbo"),
        F.when((F.col("n") > 0) & (F.col("n") < SHORT), "short_history"),
        F.when(F.col("dsr_p_value") > 0.05, "dsr"),
    )
    return F.filter(told, lambda x: x.isNotNull())


def conclusion() -> Column:
    good = (F.col("annual_return") > 0.05) & (F.col("deflated_sharpe") > 0.5)
    return F.when(good, "positive").when(F.col("annual_return") > 0, "neutral").otherwise("cautious")


def lines(record: dict, verdicts: dict, strategies: list[dict], benchmarks: list[dict], annual_turnover: float, cpcv: dict | None = None) -> list[str]:
    """The report's lines from one record (with pbo, warnings, conclusion) and the small tables above; cpcv is a summary with paths."""
    pct = lambda x: f"{100 * x:+.2f}%"
    out = ["[performance]", f"annual return: {pct(record['annual_return'])}", f"Sharpe ratio: {record['sharpe']:.3f}"]
    out += [f"deflated Sharpe: {record['deflated_sharpe']:.3f} (p = {record['dsr_p_value']:.4f})", f"Sortino ratio: {record['sortino']:.3f}", f"Calmar ratio: {record['calmar']:.3f}"]
    out += [f"maximum drawdown: {pct(record['max_drawdown'])}", f"longest drawdown: {record['max_dd_duration_days']:.0f} days", f"win rate: {100 * record['win_rate']:.1f}%", f"profit factor: {record['profit_factor']:.2f}"]
    out += ["", "[overfitting]", f"PBO: {record['pbo']:.3f}"]
    if cpcv and cpcv["n_paths"] > 0:
        out += [f"CPCV Sharpe: {cpcv['mean_sharpe']:.3f} +/- {cpcv['std_sharpe']:.3f}", f"CPCV paths: {cpcv['n_paths']}, positive: {100 * cpcv['pct_positive']:.0f}%"]
    out += [f"warning: {w}" for w in record["warnings"]]
    out += ["", "[benchmarks]", *(f"against {b['series']}: {100 * record['annual_return'] - b['cagr_pct']:+.2f}% ({b['cagr_pct']:+.2f}%)" for b in benchmarks)]
    out += ["", "[costs]", f"annual turnover: {100 * annual_turnover:.1f}%"]
    out += ["", "[strategies]", *(f"{s['strategy']}: {s['quarters']} ({s['share_pct']:.0f}%)" for s in strategies)]
    out += ["", "[review]", *(f"{k}: {verdicts[k]}" for k in ("approved", "downgraded", "rejected"))]
    return [*out, "", "[conclusion]", record["conclusion"]]


def summary(run: dict[str, DataFrame], log: DataFrame, benchmark: DataFrame | None = None, step_days: int = 63) -> DataFrame:
    """One row: the record of a run's equity (deflated by its effective trials), n_trials, pbo, annual_turnover, verdict counts, warnings, conclusion.

    A run's curve is one series of a few thousand rows, cut to a table that record, matrix and PBO read.
    """
    line = cut(backtest.equity_returns(run["equity"]))
    matrix = backtest.matrix_of(line, run["steps"].count())
    n_trials = overfit.effective_trials(matrix).first()
    n_trials = max(int(n_trials[0]) if n_trials else 1, 1)
    place = F.expr("date_add(date'1970-01-01', int(seq_no))")
    found = metrics.record(line.select(F.lit("run").alias("series_id"), place.alias("dt"), "ret"), n_trials=n_trials, benchmark=benchmark)
    # the first step moves nothing and counts
    moved = run["turnover"].agg(F.coalesce(F.avg(F.coalesce("turnover", F.lit(0.0))), F.lit(0.0)).alias("t"))
    rows = found.drop("series_id").withColumn("n_trials", F.lit(n_trials)).crossJoin(F.broadcast(overfit.pbo(matrix).select("pbo")))
    rows = rows.crossJoin(F.broadcast(moved.select((F.col("t") * YEAR / step_days).alias("annual_turnover")))).crossJoin(F.broadcast(verdict_counts(log)))
    return rows.withColumn("warnings", warnings()).withColumn("conclusion", conclusion())


def text(told: DataFrame, log: DataFrame, benchmark_rets: DataFrame, cpcv: DataFrame | None = None) -> DataFrame:
    """(line_no, line) of the report: told is summary()'s row, benchmark_rets are (series, dt, ret).  Only single rows and rows a strategy reach the driver."""
    spark = told.sparkSession
    record = told.first().asDict()
    used = [r.asDict() for r in strategy_counts(log).orderBy("place").collect()]
    marks = [r.asDict() for r in cagr(benchmark_rets, "series").orderBy("series").collect()]
    out = lines(record, record, used, marks, record["annual_turnover"], cpcv.first().asDict() if cpcv is not None else None)
    return spark.createDataFrame(list(enumerate(out, 1)), "line_no int, line string")


def write(spark, text: list[str], path: str) -> None:
    """The report as one text file in a folder of any store that Spark writes to."""
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.mode("overwrite").text(path)
