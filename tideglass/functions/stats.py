"""Statistics as column expressions, and the normal distribution."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()


def guarded(a: Column, b: Column, other: float = 0.0) -> Column:
    """a / b where b > 0, else the other value."""
    return F.when(b > 0, a / b).otherwise(F.lit(other))


def skewness(x: str) -> Column:
    """Bias-corrected G1; 0 for a constant series of 3 or more."""
    n = F.count(x)
    g = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(g, F.lit(0.0)))


def kurtosis(x: str) -> Column:
    """Bias-corrected G2 plus 3; 3 for a constant series of 4 or more."""
    n = F.count(x)
    g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n >= 4, F.coalesce(F.when(F.kurtosis(x).isNotNull(), g), F.lit(0.0)) + 3)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, which Spark lacks; made on use, as a UDF needs a session."""

    def cdf(x: pd.Series) -> pd.Series:
        from statistics import NormalDist as N

        return x.map(N().cdf, na_action="ignore")

    return F.pandas_udf(cdf, "double")(x)


def trade_cost(value: Column, volume: Column | None = None, commission: float = 0.00025, minimum: float = 5.0, slippage_bps: float = 2.0, stamp: float = 0.0005) -> Column:
    """Cost of buying and selling `value`: both commissions, both slippages, stamp duty, square-root impact."""
    fee = F.greatest(value * commission, F.lit(minimum))
    impact = F.lit(0.0)
    if volume is not None:
        share = F.greatest(F.try_divide(value, volume), F.lit(1e-10))
        impact = F.when(volume > 0, value * 0.001 * F.sqrt(share)).otherwise(0.0)
    return 2 * fee + 2 * value * slippage_bps / 1e4 + value * stamp + impact
