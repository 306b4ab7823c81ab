"""Walk-forward schedules, membership and combinatorial splits over a trading calendar.

A calendar is one row a trading day; it goes into one array, and each step is a row that looks its
dates up in it, so the as-of lookups need no join.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_STEPS = 100


def calendar(panel: DataFrame) -> DataFrame:
    """One row with days: the sorted distinct dates (a few hundred a year)."""
    return panel.select("dt").distinct().agg(F.array_sort(F.collect_list("dt")).alias("days"))


def walk_forward(panel: DataFrame, train_years: int = 3, step_months: int = 3, purge: int = 5, embargo: int = 10, max_steps: int = MAX_STEPS) -> DataFrame:
    """(step, train_end, test_start, test_end, prev_test_end, n_train, n_test) up to the first step that cannot be."""
    first = lambda after: F.get(F.filter("days", after), F.lit(0))
    rows = calendar(panel).select("days", F.explode(F.sequence(F.lit(0), F.lit(max_steps - 1))).alias("step"))
    begin = F.add_months(F.get("days", F.lit(0)), 12 * train_years)
    rows = rows.withColumn("cand", F.add_months(begin, F.col("step") * step_months))
    rows = rows.withColumn("train_end", first(lambda d: d >= F.col("cand")))
    rows = rows.withColumn("test_start", first(lambda d: d > F.date_add("train_end", purge)))
    until = F.add_months("test_start", step_months)
    rows = rows.withColumn("test_end", F.coalesce(first(lambda d: d >= until), F.array_max("days")))
    rows = rows.withColumn("prev_test_end", F.lag("test_end").over(W.orderBy("step")))
    train = F.filter("days", lambda d: trained(d, F.col("train_end"), F.col("prev_test_end"), purge, embargo))
    rows = rows.withColumn("n_train", F.size(train)).withColumn("n_test", F.size(F.filter("days", lambda d: (d >= F.col("test_start")) & (d <= F.col("test_end")))))
    good = F.coalesce(F.col("train_end").isNotNull() & F.col("test_start").isNotNull() & (F.col("n_train") >= 20) & (F.col("n_test") >= 2), F.lit(False))
    stop = F.min(F.when(~good, F.col("step"))).over(W.orderBy("step").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("_stop", stop).where("_stop is null or step < _stop").select("step", "train_end", "test_start", "test_end", "prev_test_end", "n_train", "n_test")


def local(steps: DataFrame) -> DataFrame:
    """The steps as literal rows (at most MAX_STEPS a parameter set): later plans do not derive them again."""
    return steps.sparkSession.createDataFrame(steps.orderBy("step").collect(), steps.schema)


def trained(d, train_end, prev_test_end, purge: int, embargo: int):
    """Whether a day is in a step's training set: not in the purged days nor in the last test's embargo."""
    held = F.coalesce((d >= prev_test_end) & (d <= F.date_add(prev_test_end, embargo)), F.lit(False))
    return (d <= train_end) & ~((d >= F.date_sub(train_end, purge)) & (d <= train_end)) & ~held


def members(panel: DataFrame, steps: DataFrame, purge: int = 5, embargo: int = 10) -> DataFrame:
    """(step, side, dt, asset, price): each step's training and test rows; steps (at most MAX_STEPS) are broadcast."""
    train = F.broadcast(steps)
    is_train = trained(F.col("dt"), F.col("train_end"), F.col("prev_test_end"), purge, embargo)
    a = panel.join(train, is_train).select("step", F.lit("train").alias("side"), "dt", "asset", "price")
    b = panel.join(train, F.col("dt").between(F.col("test_start"), F.col("test_end"))).select("step", F.lit("test").alias("side"), "dt", "asset", "price")
    return a.unionByName(b)


def embargo_log(panel: DataFrame, steps: DataFrame, embargo: int = 10) -> DataFrame:
    """(step, embargo_start, embargo_end, excluded): days up to the train end that the embargo covers."""
    later = steps.where("prev_test_end is not null").select("step", "train_end", F.col("prev_test_end").alias("embargo_start"), F.date_add("prev_test_end", embargo).alias("embargo_end"))
    held = lambda d: (d >= F.col("embargo_start")) & (d <= F.col("embargo_end")) & (d <= F.col("train_end"))
    return later.crossJoin(calendar(panel)).select("step", "embargo_start", "embargo_end", F.size(F.filter("days", held)).alias("excluded"))


def step_returns(rows: DataFrame, key: str = "step") -> DataFrame:
    """(key, side, dt, asset, ret): returns over the rows that are there, so removed days are spanned."""
    before = F.lag("price").over(W.partitionBy(key, "side", "asset").orderBy("dt"))
    return rows.select(key, "side", "dt", "asset", (F.try_divide("price", before) - 1).alias("ret")).where("ret is not null")


def cpcv_paths(spark: SparkSession, n_groups: int = 6, n_test: int = 2) -> DataFrame:
    """(path, grp, side, cut_tail, cut_head): every choice of test groups, in lexicographic order."""
    rows = []
    for path, chosen in enumerate(combinations(range(n_groups), n_test)):
        for g in range(n_groups):
            rows.append((path, g, "test" if g in chosen else "train", g - 1 in chosen, g + 1 in chosen))
    return spark.createDataFrame(rows, "path int, grp int, side string, cut_tail boolean, cut_head boolean")


def cpcv_members(panel: DataFrame, n_groups: int = 6, n_test: int = 2, purge: int = 5, embargo: int = 10) -> DataFrame:
    """(path, side, dt, asset, price): a training group loses its last `purge` days behind a test group and its first `embargo` days before one."""
    days = panel.select("dt").distinct().withColumn("i", F.row_number().over(W.orderBy("dt")) - 1)
    size = F.floor(F.count("*").over(W.partitionBy()) / n_groups)
    days = days.withColumn("size", size).where(F.col("i") < F.col("size") * n_groups)
    days = days.withColumn("grp", F.floor(F.col("i") / F.col("size")).cast("int")).withColumn("k", F.col("i") % F.col("size"))
    rows = days.join(F.broadcast(cpcv_paths(panel.sparkSession, n_groups, n_test)), "grp")
    lost = (F.col("side") == "train") & ((F.col("cut_tail") & (F.col("k") >= F.col("size") - purge)) | (F.col("cut_head") & (F.col("k") < embargo)))
    return panel.join(F.broadcast(rows.where(~lost).select("path", "side", "dt")), "dt").select("path", "side", "dt", "asset", "price")
