"""Panel operators on long rows (dt, asset, price): returns, filters, cleaning, splits.

Windows run over one asset's rows; what is needed across assets is a grouped aggregate by date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def by_asset() -> WindowSpec:
    """One asset's rows in time order (made on use, as windows need a session)."""
    return W.partitionBy("asset").orderBy("dt")


def complete(panel: DataFrame, value: str = "price") -> DataFrame:
    """Rows of the dates on which every asset has a value."""
    n = panel.agg(F.count_distinct("asset").alias("_assets"))
    rows = panel.withColumn("_valued", F.count(value).over(W.partitionBy("dt")))
    return rows.join(F.broadcast(n), F.col("_valued") == F.col("_assets")).drop("_valued", "_assets")


def returns(panel: DataFrame) -> DataFrame:
    """(dt, asset, ret): simple returns over the complete dates; holes are spanned, the first date has none."""
    ratio = F.try_divide("price", F.lag("price").over(by_asset())) - 1
    return complete(panel).select("dt", "asset", ratio.alias("ret")).where("ret is not null")


def portfolio(rets: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(dt, ret): equal-weight mean by date, or the dot product with weights (asset, w)."""
    if weights is None:
        return rets.groupBy("dt").agg(F.avg("ret").alias("ret"))
    return rets.join(F.broadcast(weights), "asset").groupBy("dt").agg(F.sum(F.col("ret") * F.col("w")).alias("ret"))


def extreme_flags(panel: DataFrame, limit: float = 0.2) -> DataFrame:
    """(dt, asset, ret) of moves beyond the limit: a log, nothing is changed."""
    move = F.try_divide("price", F.lag("price").over(by_asset())) - 1
    return panel.select("dt", "asset", move.alias("ret")).where(F.abs("ret") > limit)


def grid(panel: DataFrame) -> DataFrame:
    """Every date of the panel with every asset; cells without a row have a null price."""
    dates, assets = panel.select("dt").distinct(), panel.select("asset").distinct()
    return dates.crossJoin(F.broadcast(assets)).join(panel, ["dt", "asset"], "left")


def halts(panel: DataFrame, run: int = 4) -> DataFrame:
    """panel with streak (rows since the price last moved) and price nulled in flat runs of `run` rows or more."""
    flat = F.coalesce(F.abs(F.col("price") - F.lag("price").over(by_asset())) < 1e-12, F.lit(False))
    rows = panel.withColumn("_flat", flat)
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_flat"), 0).otherwise(1)).over(by_asset().rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy("asset", "_island").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("streak", F.sum(F.col("_flat").cast("int")).over(inside))
    price = F.when(F.col("streak") >= run, F.lit(None)).otherwise(F.col("price"))
    return rows.withColumn("price", price).drop("_flat", "_island")


def fill_forward(panel: DataFrame, limit: int = 3) -> DataFrame:
    """Null prices take the asset's last price of at most `limit` rows before."""
    return panel.withColumn("price", F.last("price", ignorenulls=True).over(by_asset().rowsBetween(-limit, 0)))


def _bounds(sigmas: float, tail: float) -> tuple[Callable[[WindowSpec | None], Column], Callable[[WindowSpec | None], Column]]:
    """Lower and upper bound of `ret`, each over a window or, given none, as an aggregate."""
    over = lambda c, w: c if w is None else c.over(w)
    mean, sd = lambda w: over(F.avg("ret"), w), lambda w: over(F.stddev_samp("ret"), w)
    q = lambda w, p: over(F.percentile("ret", F.lit(p)), w)
    return (lambda w: F.greatest(mean(w) - sigmas * sd(w), q(w, tail)), lambda w: F.least(mean(w) + sigmas * sd(w), q(w, 1 - tail)))


def winsor_bounds(rets: DataFrame, sigmas: float = 5.0, tail: float = 0.005) -> DataFrame:
    """(asset, lo, hi): the tighter of mean -/+ sigmas deviations and the tail quantiles."""
    lo, hi = _bounds(sigmas, tail)
    return rets.groupBy("asset").agg(lo(None).alias("lo"), hi(None).alias("hi"))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """x held between lo and hi; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def clean(panel: DataFrame) -> DataFrame:
    """(dt, asset, price): flat runs nulled, short holes filled, incomplete dates dropped, returns clipped, prices rebuilt."""
    filled = fill_forward(halts(grid(panel.select("dt", "asset", "price"))))
    # the grid has every asset on every date, so a complete date is one without a null
    whole = filled.withColumn("_holes", F.count_if(F.col("price").isNull()).over(W.partitionBy("dt"))).where("_holes = 0")
    rets = whole.select("dt", "asset", "price", (F.try_divide("price", F.lag("price").over(by_asset())) - 1).alias("ret"))
    lo, hi = (f(W.partitionBy("asset")) for f in _bounds(5.0, 0.005))
    rets = rets.select("*", lo.alias("lo"), hi.alias("hi"))
    path = by_asset().rowsBetween(W.unboundedPreceding, 0)
    first = F.first("price").over(path)
    grown = F.sum(F.log1p(clip(F.col("ret"), F.col("lo"), F.col("hi")))).over(path)
    return rets.select("dt", "asset", (first * F.exp(F.coalesce(grown, F.lit(0.0)))).alias("price"))


def split(panel: DataFrame, train_end: str, val_end: str, purge: int = 5) -> DataFrame:
    """panel with split: train, val, test, or null in the purged gaps."""
    a, b = F.lit(train_end).cast("date"), F.lit(val_end).cast("date")
    part = F.when(F.col("dt") <= F.date_sub(a, purge), "train").when((F.col("dt") > a) & (F.col("dt") <= b), "val").when(F.col("dt") > F.date_add(b, purge), "test")
    return panel.withColumn("split", part)


def covariance(rets: DataFrame) -> DataFrame:
    """(asset_i, asset_j, cov, corr) over the dates both have; corr is null where a deviation is 0."""
    x = rets.select("dt", F.col("asset").alias("asset_i"), F.col("ret").alias("x"))
    y = rets.select("dt", F.col("asset").alias("asset_j"), F.col("ret").alias("y"))
    both = x.join(y, "dt").groupBy("asset_i", "asset_j")
    cov = F.covar_samp("x", "y")
    return both.agg(cov.alias("cov"), F.try_divide(cov, F.stddev_samp("x") * F.stddev_samp("y")).alias("corr"))


def asset_index(panel: DataFrame) -> DataFrame:
    """(asset, asset_idx): positions of the assets in order of their names."""
    return panel.select("asset").distinct().select("asset", (F.row_number().over(W.orderBy("asset")) - 1).alias("asset_idx"))
