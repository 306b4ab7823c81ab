"""Risk and return records of return series (series_id, dt, ret); every series in one plan.

All windows (drawdown, spells, rolling Sharpe, whole-series quantiles) part by series, so the rows are shuffled once; one
aggregate over the same partitions and arithmetic on one row a series follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tideglass.functions.stats import NORMAL, guarded, kurtosis, normal_cdf, skewness

def by() -> WindowSpec:
    """One series in time order (made on use, as windows need a session)."""
    return W.partitionBy("series_id").orderBy("dt")


def up() -> WindowSpec:
    return by().rowsBetween(W.unboundedPreceding, 0)


def series(df: DataFrame, name: str = "all") -> DataFrame:
    return df.select(F.lit(name).alias("series_id"), "dt", "ret")


def drawdowns(s: DataFrame) -> DataFrame:
    """(series_id, dt, ret, cum, dd): growth without the starting 1, and its fall from the running peak.

    Growth is the exponential of summed logs; a return of -1 or less ends it at 0.
    """
    lost = F.max((F.col("ret") <= -1).cast("int")).over(up()) == 1
    grown = F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))).over(up()))
    rows = s.withColumn("cum", F.when(lost, F.lit(0.0)).otherwise(grown))
    return rows.withColumn("dd", F.round(F.try_divide("cum", F.max("cum").over(up())) - 1, 12))


def drawdown_durations(d: DataFrame) -> DataFrame:
    """(series_id, island, rows, is_open): spells under water; an open one counts one row less."""
    rows = d.withColumn("island", F.sum((F.col("dd") == 0).cast("int")).over(up())).withColumn("is_last", F.lead("dt").over(by()).isNull())
    spells = rows.groupBy("series_id", "island").agg(F.count_if(F.col("dd") < 0).alias("n"), F.max(F.col("is_last") & (F.col("dd") < 0)).alias("is_open"))
    return spells.where("n > 0").select("series_id", "island", (F.col("n") - F.col("is_open").cast("int")).alias("rows"), "is_open")


def _moments() -> list[Column]:
    loss = F.when(F.col("ret") < 0, F.col("ret"))
    win = F.when(F.col("ret") > 0, F.col("ret"))
    return [
        F.count("ret").alias("n"),
        (F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret")))) * F.when(F.min("ret") <= -1, 0.0).otherwise(1.0) - 1).alias("total_return"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(loss).alias("loss_sd"),
        F.sum(win).alias("win_sum"),
        F.sum(loss).alias("loss_sum"),
        F.count(win).alias("wins"),
        skewness("ret").alias("skewness"),
        kurtosis("ret").alias("kurtosis"),
    ]


def basics(s: DataFrame) -> DataFrame:
    """One row a series: n, annual factor, moments, 5 % quantile, counts."""
    gap = s.withColumn("gap", F.datediff("dt", F.lag("dt").over(by())))
    ann = F.when(F.percentile("gap", F.lit(0.5)) > 5, 12).otherwise(252)
    return gap.groupBy("series_id").agg(ann.alias("ann"), F.percentile("ret", F.lit(0.05)).alias("var_95"), *_moments())


def observed(s: DataFrame) -> DataFrame:
    """s with what the record reads of each row: i, dd, under (rows since the peak, closed spells and open ones but
    their last row), n, mean, var_95 and ann of its series, and rolling (annualised Sharpe of the full window that ends here).

    A window's width w depends on its series: the row w before is the one before among the rows of equal i modulo w, so sums
    up to both give the window's sums for every width.
    """
    whole = W.partitionBy("series_id")
    rows = drawdowns(s).withColumn("i", F.row_number().over(by())).withColumn("gap", F.datediff("dt", F.lag("dt").over(by())))
    peak = F.last(F.when(F.col("dd") == 0, F.col("i")), ignorenulls=True).over(up())
    rows = rows.withColumn("under", F.when((F.col("dd") < 0) & F.lead("dt").over(by()).isNotNull(), F.col("i") - peak))
    ann = F.when(F.percentile("gap", F.lit(0.5)).over(whole) > 5, 12).otherwise(252)
    rows = rows.select("*", F.count("ret").over(whole).alias("n"), F.avg("ret").over(whole).alias("mean"), F.percentile("ret", F.lit(0.05)).over(whole).alias("var_95"), ann.alias("ann"))
    # deviations from the series' mean keep the sums small
    x = F.col("ret") - F.col("mean")
    rows = rows.withColumn("w", F.least(F.col("ann"), F.floor(F.col("n") / 2)).cast("int")).select("*", F.sum(x).over(up()).alias("a"), F.sum(x * x).over(up()).alias("b"))
    same = W.partitionBy("series_id", F.pmod("i", F.greatest("w", F.lit(1)))).orderBy("i")
    rows = rows.select("*", F.lag("a", 1, 0.0).over(same).alias("a0"), F.lag("b", 1, 0.0).over(same).alias("b0"))
    m = (F.col("a") - F.col("a0")) / F.col("w")
    var = (F.col("b") - F.col("b0")) / F.col("w") - m * m
    value = F.when(var > 1e-18, (m + F.col("mean")) / F.sqrt(var) * F.sqrt("ann")).otherwise(0.0)
    return rows.withColumn("rolling", F.when((F.col("i") >= F.col("w")) & (F.col("w") >= 2), value)).drop("a", "b", "a0", "b0", "w")


def record(s: DataFrame, n_trials: int = 1, risk_free: float = 0.02, confidence: float = 0.95, benchmark: DataFrame | None = None) -> DataFrame:
    """The full record, one row a series; series of fewer than 2 returns give zeros."""
    tail = F.when(F.col("ret") <= F.col("var_95") + 1e-15, F.col("ret"))
    rows = observed(s.where("ret is not null")).groupBy("series_id").agg(
        F.max("ann").alias("ann"),
        F.max("var_95").alias("var_95"),
        F.avg(tail).alias("cvar_95"),
        F.min("dd").alias("max_drawdown"),
        F.max("under").alias("max_dd_duration_days"),
        F.avg("rolling").alias("rolling_sharpe"),
        *_moments(),
    )
    years = F.col("n") / F.col("ann")
    rows = rows.withColumn("annual_return", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / years) - 1).otherwise(-1.0))
    rows = rows.withColumn("volatility", F.col("sd") * F.sqrt("ann"))
    rows = rows.withColumn("sharpe", guarded(F.col("annual_return") - risk_free, F.col("volatility")))
    rows = rows.withColumn("sortino", guarded(F.col("annual_return") - risk_free, F.col("loss_sd") * F.sqrt("ann")))
    rows = rows.withColumn("calmar", guarded(F.col("annual_return"), -F.col("max_drawdown")))
    rows = rows.withColumn("win_rate", F.col("wins") / F.col("n"))
    rows = rows.withColumn("profit_factor", F.when(F.col("loss_sum") < 0, F.abs(F.coalesce("win_sum", F.lit(0.0)) / F.col("loss_sum"))).otherwise(F.lit(float("inf"))))
    rows = rows.withColumn("rolling_sharpe_12m", F.coalesce("rolling_sharpe", "sharpe"))
    z = NORMAL.inv_cdf((1 + confidence) / 2)
    mid = guarded(F.col("mean") * F.col("ann") - risk_free, F.col("volatility"))
    spread = (1 + 0.5 * mid * mid - F.col("skewness") * mid + (F.col("kurtosis") - 3) / 4 * mid * mid) / F.greatest(years, F.lit(1.0))
    se = F.sqrt(F.greatest(spread, F.lit(1e-10)))
    rows = rows.withColumn("sharpe_ci_lower", mid - z * se).withColumn("sharpe_ci_upper", mid + z * se)
    rows = deflated(rows, F.col("sharpe"), F.greatest(years, F.lit(1.5)), n_trials)
    rows = rows.withColumn("excess_return", F.col("annual_return") - risk_free)
    if benchmark is None:
        rows = rows.withColumn("excess_vs_benchmark", F.lit(0.0))
    else:
        b = benchmark.where("ret is not null").agg(F.count("ret").alias("bn"), F.sum(F.log1p("ret")).alias("bl"))
        rows = rows.crossJoin(F.broadcast(b)).withColumn("excess_vs_benchmark", F.col("annual_return") - F.exp(F.col("bl") * F.col("ann") / F.col("bn")) + 1)
    rows = rows.withColumn("freq", F.when(F.col("ann") == 12, "monthly").otherwise("daily"))
    names = ["total_return", "annual_return", "volatility", "sharpe", "sharpe_ci_lower", "sharpe_ci_upper", "deflated_sharpe", "dsr_p_value", "sortino", "calmar", "max_drawdown", "max_dd_duration_days", "win_rate", "profit_factor", "excess_return", "excess_vs_benchmark", "skewness", "kurtosis", "rolling_sharpe_12m", "var_95", "cvar_95"]
    short = F.col("n") < 2
    zero = [F.when(short, F.lit(0.0)).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in names]
    return rows.select("series_id", "n", *zero, F.when(short, 0.0).otherwise(F.col("mean")).alias("period_return_mean"), F.when(short, 0.0).otherwise(F.col("sd")).alias("period_vol"), "freq")


def deflated(rows: DataFrame, sharpe, n_obs, n_trials: int) -> DataFrame:
    """rows with deflated_sharpe and dsr_p_value for the best of n_trials; one trial is not deflated."""
    import math

    if n_trials <= 1:
        return rows.withColumn("deflated_sharpe", sharpe).withColumn("dsr_p_value", F.lit(1.0))
    var = (1 + 0.5 * F.col("skewness") * sharpe - 0.25 * (F.col("kurtosis") - 3) * sharpe * sharpe) / (n_obs - 1)
    sigma = F.sqrt(F.greatest(var, F.lit(1e-10)))
    raw = (sharpe - sigma * math.sqrt(2 * math.log(n_trials))) / sigma
    rows = rows.withColumn("_dsr", raw).withColumn("deflated_sharpe", F.least(F.greatest(raw, F.lit(-50.0)), F.lit(50.0)))
    return rows.withColumn("dsr_p_value", 1 - normal_cdf(F.col("_dsr"))).drop("_dsr")
