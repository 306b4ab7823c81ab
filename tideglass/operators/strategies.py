"""Built-in strategies as plans over training returns (key, dt, asset, ret), and custom callables.

Each gives (key, asset, w); all keys (steps, paths, parameter sets) are weighed in one plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAMES = ("equal", "momentum", "risk_parity", "defensive")


def _normal(rows: DataFrame, key: str) -> DataFrame:
    """Raw scores to weights of sum 1; equal weights where the scores sum to nothing or are not finite."""
    all_ = W.partitionBy(key)
    ok = F.bool_and(F.col("raw").isNotNull() & ~F.isnan("raw") & (F.abs("raw") < float("inf"))).over(all_) & (F.sum("raw").over(all_) > 0)
    w = F.when(ok, F.col("raw") / F.sum("raw").over(all_)).otherwise(1 / F.count("*").over(all_))
    return rows.select(key, "asset", w.alias("w"))


def equal(rets: DataFrame, key: str = "step") -> DataFrame:
    return _normal(rets.groupBy(key, "asset").agg(F.lit(1.0).alias("raw")), key)


def momentum(rets: DataFrame, key: str = "step", lookback: int = 63) -> DataFrame:
    """Positive growth over the last `lookback` days; equal with fewer days or if none grew."""
    newest = W.partitionBy(key, "asset").orderBy(F.desc("dt"))
    last = rets.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= lookback)
    grown = F.exp(F.sum(F.log1p("ret"))) - 1
    rows = last.groupBy(key, "asset").agg(F.count("*").alias("n"), grown.alias("g"))
    raw = F.when(F.min("n").over(W.partitionBy(key)) < lookback, 1.0).otherwise(F.greatest("g", F.lit(0.0)))
    return _normal(rows.select(key, "asset", raw.alias("raw")), key)


def risk_parity(rets: DataFrame, key: str = "step") -> DataFrame:
    """Inverse volatility."""
    return _normal(rets.groupBy(key, "asset").agg((1 / F.greatest(F.stddev_samp("ret"), F.lit(1e-10))).alias("raw")), key)


def defensive(rets: DataFrame, key: str = "step", tail: int = 3) -> DataFrame:
    """The last `tail` assets count double."""
    rows = rets.select(key, "asset").distinct().withColumn("back", F.row_number().over(W.partitionBy(key).orderBy(F.desc("asset"))))
    return _normal(rows.select(key, "asset", F.when(F.col("back") <= tail, 2.0).otherwise(1.0).alias("raw")), key)


BUILT_IN: dict[str, Callable[..., DataFrame]] = {"equal": equal, "momentum": momentum, "risk_parity": risk_parity, "defensive": defensive}


def pool(rets: DataFrame, key: str = "step", names: tuple[str, ...] = NAMES) -> DataFrame:
    """(key, strategy, asset, w) of several strategies."""
    out = None
    for name in names:
        rows = BUILT_IN[name](rets, key).withColumn("strategy", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.select(key, "strategy", "asset", "w")


def custom(rets: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], key: str = "step") -> DataFrame:
    """A callable (returns, covariance) -> weights in asset order, one group a key; equal weights unless all are finite.

    A group is one training window of the panel, as the callable needs it whole.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index="dt", columns="asset", values="ret").sort_index(axis=1).dropna()
        w = np.asarray(fn(wide, wide.cov()), dtype=float)
        if w.shape != (wide.shape[1],) or not np.isfinite(w).all():
            w = np.full(wide.shape[1], 1 / wide.shape[1])
        return pd.DataFrame({key: g[key].iloc[0], "asset": wide.columns, "w": w})

    kind = dict(rets.dtypes)[key]
    return rets.select(key, "dt", "asset", "ret").groupBy(key).applyInPandas(run, f"{key} {kind}, asset string, w double")
