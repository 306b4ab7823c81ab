"""Sources: long-form price panels, news, rule files, task files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMOOTH_ROWS = 28
TASK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("instruction", T.StringType()),
        T.StructField("output_file", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("strategies", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType())]))),
        T.StructField("max_budget_pct", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_panel(spark: SparkSession, sf_dir: str, by_status: bool = False, weekly: bool = False, smooth: int = SMOOTH_ROWS) -> DataFrame:
    """(dt, asset, price, volume): mean unit price of line items by day, averaged over the asset's last `smooth` rows.

    One shuffle by (dt, asset) with map-side partial sums, then one by asset for the average.
    """
    asset = F.concat("l_returnflag", "l_linestatus") if by_status else F.col("l_returnflag")
    day = F.to_date("l_shipdate")
    dt = F.to_date(F.date_trunc("week", "l_shipdate")) if weekly else day
    rows = table(spark, sf_dir, "lineitem").select(dt.alias("dt"), asset.alias("asset"), "l_extendedprice", "l_quantity")
    daily = rows.groupBy("dt", "asset").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.sum("l_extendedprice").alias("volume"))
    last = W.partitionBy("asset").orderBy("dt").rowsBetween(-(smooth - 1), 0)
    return daily.select("dt", "asset", F.round(F.avg("p").over(last), 6).alias("price"), F.round("volume", 4).alias("volume"))


def price_source(spark: SparkSession, path: str, asset: str, fmt: str = "csv", date_col: str = "date", price_col: str = "close") -> DataFrame:
    """One asset's file to (dt, asset, price): unparsable numbers become null, rows without a date are dropped."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    rows = reader.format(fmt).load(path)
    return rows.select(F.expr(f"try_cast(`{date_col}` as date)").alias("dt"), F.lit(asset).alias("asset"), F.expr(f"try_cast(`{price_col}` as double)").alias("price")).where("dt is not null")


def panel_of(sources: list[DataFrame], days: int | None = None) -> DataFrame:
    """Union of single-asset sources, optionally the last `days` days; an empty list is an error."""
    if not sources:
        raise ValueError("no price source")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return rows.where(F.col("dt") >= F.date_sub(F.current_date(), days)) if days is not None else rows


def synthetic_panel(spark: SparkSession, start: str = "2020-01-01", end: str = "2025-12-31", seed: int = 42, base: tuple[tuple[str, float], ...] = (("A", 100.0), ("B", 50.0))) -> DataFrame:
    """Seeded business-day random walks, one a named asset, drawn one after the other."""
    import numpy as np
    import pandas as pd

    days = pd.bdate_range(start, end)
    rng = np.random.RandomState(seed)
    parts = [pd.DataFrame({"dt": days.date, "asset": name, "price": rng.randn(len(days)).cumsum() + level}) for name, level in base]
    return spark.createDataFrame(pd.concat(parts), "dt date, asset string, price double")


def news_source(frames: list[DataFrame]) -> DataFrame | None:
    """Union by name of news frames; columns one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def rule_items(spark: SparkSession, path: str) -> DataFrame:
    """(item_no, marker, check) of a markdown rule file: `- [ ] text` items under headings that end in [MARKER].

    A rule file is one small document read in line order, so it is one partition by design.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    order = W.orderBy("line_no")
    heading = F.when(F.col("line").rlike(r"^\s*#"), F.nullif(F.regexp_extract("line", r"\[([A-Z0-9_]+)\]\s*$", 1), F.lit("")))
    rows = lines.withColumn("marker", F.last(heading, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.where(F.col("line").rlike(r"^\s*-\s*\[.\]\s+")).withColumn("check", F.trim(F.regexp_replace("line", r"^\s*-\s*\[.\]\s+", "")))
    return rows.select(F.row_number().over(order).alias("item_no"), F.coalesce("marker", F.lit("")).alias("marker"), "check")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task rows of a JSON array, missing fields at their defaults."""
    rows = spark.read.schema(TASK_SCHEMA).json(path, multiLine=True)
    default = {"level": F.lit("L0"), "status": F.lit("pending"), "max_budget_pct": F.lit(0.4), "tags": F.array().cast("array<string>"), "output_file": F.lit(""), "title": F.col("id")}
    for name, value in default.items():
        rows = rows.withColumn(name, F.coalesce(name, value))
    return rows
