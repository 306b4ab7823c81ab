"""Causal rolling features of a panel: each row looks back only, so they are computed once for all steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.operators.panel import covariance, returns  # noqa: F401


def _full(fn, x: str, w, n: int):
    """fn over the window's last n rows, null until they are there."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(f) == n, fn(x).over(f))


def compute(rets: DataFrame, window: int = 20) -> DataFrame:
    """(dt, ret_1d, ret_5d, ret_20d, vol_20d, max_corr, spread) of returns (dt, asset, ret) on complete dates.

    Pairs of assets are compared window by window in one plan partitioned by pair.
    """
    mean = rets.groupBy("dt").agg(F.avg("ret").alias("ret_1d"), F.stddev_samp("ret").alias("spread"))
    line = W.orderBy("dt")
    mean = mean.select("dt", "ret_1d", _full(F.avg, "ret_1d", line, 5).alias("ret_5d"), _full(F.avg, "ret_1d", line, 20).alias("ret_20d"), _full(F.stddev_samp, "ret_1d", line, window).alias("vol_20d"), "spread")
    x = rets.select("dt", F.col("asset").alias("i"), F.col("ret").alias("x"))
    y = rets.select("dt", F.col("asset").alias("j"), F.col("ret").alias("y"))
    f = W.partitionBy("i", "j").orderBy("dt").rowsBetween(-(window - 1), 0)
    corr = F.try_divide(F.covar_samp("x", "y").over(f), F.stddev_samp("x").over(f) * F.stddev_samp("y").over(f))
    pairs = x.join(y, "dt").where("i < j").select("dt", F.when(F.count("*").over(f) == window, corr).alias("c"))
    top = pairs.groupBy("dt").agg(F.when(F.count("c") == F.count("*"), F.max("c")).alias("max_corr"))
    rows = mean.join(top, "dt", "left")
    names = ["ret_1d", "ret_5d", "ret_20d", "vol_20d", "max_corr", "spread"]
    return rows.select("dt", *names).where(" and ".join(f"{c} is not null" for c in names))


def trend_sentiment(panel: DataFrame, short: int = 50, long: int = 200, smooth: int = 60) -> DataFrame:
    """(dt, sentiment): share of the last days with the short average of the mean price above the long one; 0.5 before `long` days."""
    line = W.orderBy("dt")
    mean = panel.groupBy("dt").agg(F.avg("price").alias("p"))
    up = F.coalesce(_full(F.avg, "p", line, short) > _full(F.avg, "p", line, long), F.lit(False)).cast("double")
    rows = mean.withColumn("up", up).withColumn("i", F.row_number().over(line))
    share = F.avg("up").over(line.rowsBetween(-(smooth - 1), 0))
    return rows.select("dt", F.when(F.col("i") < long, 0.5).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).alias("sentiment"))
