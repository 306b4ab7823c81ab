"""Walk-forward simulation: weights, turnover, the fold of capital over steps, the equity curve.

Only the capital recurrence is sequential (the minimum commission makes it non-linear); it folds one
row a step, at most schedule.MAX_STEPS, inside an aggregate expression.  Everything below a step is windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.functions.stats import trade_cost
from tideglass.operators import schedule
from tideglass.operators.ordered import running

CAPITAL = 1_000_000.0
COST_CAP = 0.005


def turnover(weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., step, turnover): sum of absolute weight changes; null at the first step."""
    before = F.lag("w").over(W.partitionBy(*by, "asset").orderBy("step"))
    return weights.withColumn("move", F.abs(F.col("w") - before)).groupBy(*by, "step").agg(F.sum("move").alias("turnover"))


def step_paths(test_rets: DataFrame, weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., step, dt, ret, growth): the portfolio's daily returns of each test and their running product."""
    daily = test_rets.join(weights, [*by, "step", "asset"]).groupBy(*by, "step", "dt").agg(F.sum(F.col("ret") * F.col("w")).alias("ret"))
    run = W.partitionBy(*by, "step").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("growth", F.exp(F.sum(F.log1p("ret")).over(run)))


def fold(steps: DataFrame, by: tuple[str, ...] = (), capital: float = CAPITAL, cap: float = COST_CAP, **costs: float) -> DataFrame:
    """(by..., step, turnover, growth) -> (by..., step, cost, start): the value each step starts from after its cost."""
    item = F.struct("step", "turnover", "growth")
    rows = steps.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("s"))
    empty = F.struct(F.lit(1.0).alias("pv"), F.array().cast("array<struct<step:int,cost:double,start:double>>").alias("out"))

    def step(acc, x):
        money = acc.pv * capital
        cost = F.when(x.turnover.isNull(), 0.0).otherwise(trade_cost(money * x.turnover, **costs))
        start = acc.pv * (1 - F.least(cost / money, F.lit(cap)))
        done = F.concat(acc.out, F.array(F.struct(x.step.cast("int").alias("step"), cost.alias("cost"), start.alias("start"))))
        return F.struct((start * x.growth).alias("pv"), done.alias("out"))

    return rows.select(*by, F.inline(F.aggregate("s", empty, step).out))


def equity(paths: DataFrame, turn: DataFrame, starts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., step, seq, dt, equity): a cost row at each test's first date from step 1 on, then a row a test day."""
    cost_rows = starts.join(turn.where("turnover is not null"), [*by, "step"])
    cost_rows = cost_rows.select(*by, "step", F.lit(0).alias("seq"), F.col("test_start").alias("dt"), F.col("start").alias("equity"))
    seq = F.row_number().over(W.partitionBy(*by, "step").orderBy("dt"))
    daily = paths.join(starts, [*by, "step"]).select(*by, "step", seq.alias("seq"), "dt", (F.col("start") * F.col("growth")).alias("equity"))
    return cost_rows.unionByName(daily)


def run(panel: DataFrame, weigh, train_years: int = 3, step_months: int = 3, purge: int = 5, embargo: int = 10, capital: float = CAPITAL, **costs: float) -> dict[str, DataFrame]:
    """Simulate one strategy: weigh(training returns) -> (step, asset, w).  Returns the run's tables by name."""
    steps = schedule.local(schedule.walk_forward(panel, train_years, step_months, purge, embargo))
    rows = schedule.step_returns(schedule.members(panel, steps, purge, embargo))
    weights = weigh(rows.where("side = 'train'"))
    turn = turnover(weights)
    paths = step_paths(rows.where("side = 'test'"), weights)
    growth = paths.groupBy("step").agg(F.max_by("growth", "dt").alias("growth"))
    starts = fold(turn.join(growth, "step"), capital=capital, **costs).join(F.broadcast(steps.select("step", "test_start")), "step")
    return {
        "steps": steps,
        "weights": weights,
        "turnover": turn,
        "starts": starts,
        "equity": equity(paths, turn, starts),
        "signals": weights.join(F.broadcast(steps.select("step", F.col("train_end").alias("compute_date"), F.col("test_start").alias("apply_date"))), "step"),
        "step_info": paths.groupBy("step").agg(F.avg("ret").alias("portfolio_return")).join(F.broadcast(steps.select("step", "test_start", "test_end")), "step"),
        "embargo": schedule.embargo_log(panel, steps, embargo),
    }


def equity_returns(eq: DataFrame) -> DataFrame:
    """(seq_no, dt, ret) of an equity curve in the order (step, seq); the curve is one series of a few thousand rows."""
    order = W.orderBy("step", "seq")
    rows = eq.withColumn("ret", F.col("equity") / F.lag("equity").over(order) - 1).withColumn("seq_no", F.row_number().over(order) - 1)
    return rows.where("ret is not null").select("seq_no", "dt", "ret")


def strategy_matrix(eq: DataFrame, n_steps: int) -> DataFrame:
    """(strategy_id, obs, ret): the curve's returns cut into n_steps pieces of equal length, the last one's rest trimmed."""
    return matrix_of(equity_returns(eq), n_steps)


def matrix_of(line: DataFrame, n_steps: int) -> DataFrame:
    """strategy_matrix() of returns (seq_no, ret)."""
    rets = line.withColumn("i", F.row_number().over(W.orderBy("seq_no")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    per = F.floor(F.col("n") / n_steps)
    rows = rets.withColumn("per", per).where((F.col("n") >= 20) & (F.col("per") >= 5) & F.lit(n_steps >= 2))
    rows = rows.withColumn("strategy_id", F.least(F.floor(F.col("i") / F.col("per")), F.lit(n_steps - 1)).cast("int"))
    rows = rows.withColumn("obs", (F.col("i") - F.col("strategy_id") * F.col("per")).cast("int"))
    return rows.where("obs < per").select("strategy_id", "obs", "ret")


#: Steps of one parameter set are numbered from its id times this.
_STRIDE = 1000


def sweep(panel: DataFrame, weigh, grid: list[dict[str, int]], capital: float = CAPITAL, digits: int = 6, **costs: float) -> DataFrame:
    """One row a parameter set: param_id, its fields, n, sharpe and max_drawdown to so many digits.

    All sets run in one plan: their steps are numbered apart, so weights, paths and folds of every
    set are computed side by side in the same stages.
    """
    from tideglass.operators import metrics

    spark = panel.sparkSession
    steps, rows = None, None
    for i, params in enumerate(grid):
        p = {"train_years": 3, "step_months": 3, "purge": 5, "embargo": 10} | params
        own = schedule.local(schedule.walk_forward(panel, **p)).withColumn("step", F.col("step") + i * _STRIDE)
        part = schedule.members(panel, own, p["purge"], p["embargo"])
        steps, rows = (own, part) if steps is None else (steps.unionByName(own), rows.unionByName(part))
    rets = schedule.step_returns(rows)
    param = F.floor(F.col("step") / _STRIDE).cast("int")
    weights = weigh(rets.where("side = 'train'")).withColumn("param_id", param)
    by = ("param_id",)
    turn = turnover(weights, by)
    paths = step_paths(rets.where("side = 'test'").withColumn("param_id", param), weights, by)
    growth = paths.groupBy("param_id", "step").agg(F.max_by("growth", "dt").alias("growth"))
    starts = fold(turn.join(growth, ["param_id", "step"]), by, capital, **costs)
    starts = starts.join(F.broadcast(steps.select("step", "test_start")), "step")
    order = W.partitionBy("param_id").orderBy("step", "seq")
    eq = equity(paths, turn, starts, by).withColumn("ret", F.col("equity") / F.lag("equity").over(order) - 1)
    # equity rows can share a date: their place in the curve stands for the day
    place = F.expr("date_add(date'1970-01-01', n)")
    line = eq.withColumn("n", F.row_number().over(order)).select(F.col("param_id").cast("string").alias("series_id"), place.alias("dt"), "ret")
    # the record reads the curves several times: a few thousand rows a set
    line = line.where("ret is not null").persist()
    found = metrics.record(line).select(F.col("series_id").cast("int").alias("param_id"), "n", "sharpe", "max_drawdown")
    named = spark.createDataFrame([(i, *p.values()) for i, p in enumerate(grid)], ["param_id", *grid[0]])
    zero = [F.round(F.coalesce(c, F.lit(0.0)), digits).alias(c) for c in ("sharpe", "max_drawdown")]
    return named.join(found, "param_id", "left").select("param_id", *grid[0], F.coalesce("n", F.lit(0)).alias("n"), *zero)


def cpcv_sharpes(panel: DataFrame, weigh, n_groups: int = 6, n_test: int = 2) -> DataFrame:
    """(path, sharpe): mean / deviation * sqrt(252) of each path's test returns.

    Paths of fewer than 20 training or 2 test days, or fewer than 5 or 2 days of returns, are skipped.
    """
    found = schedule.cpcv_members(panel, n_groups, n_test)
    rows = schedule.step_returns(found, "path")
    days = lambda df, name: df.groupBy("path").agg(*[F.count_distinct(F.when(F.col("side") == s, F.col("dt"))).alias(f"{name}_{s}") for s in ("train", "test")])
    long = days(found, "n").join(days(rows, "r"), "path").where("n_train >= 20 and n_test >= 2 and r_train >= 5 and r_test >= 2")
    rows = rows.join(F.broadcast(long.select("path")), "path")
    weights = weigh(rows.where("side = 'train'"), "path")
    daily = rows.where("side = 'test'").join(weights, ["path", "asset"]).groupBy("path", "dt").agg(F.sum(F.col("ret") * F.col("w")).alias("ret"))
    value = F.avg("ret") / F.greatest(F.stddev_samp("ret"), F.lit(1e-10)) * 252**0.5
    return daily.groupBy("path").agg(value.alias("sharpe"))


def cpcv_summary(sharpes: DataFrame) -> DataFrame:
    """One row: n_paths, mean, median, population deviation, share above 0."""
    return sharpes.agg(F.count("*").alias("n_paths"), F.avg("sharpe").alias("mean_sharpe"), F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"), F.avg((F.col("sharpe") > 0).cast("double")).alias("pct_positive"))


def cycle_outcomes(rets: DataFrame, cycles: int, width: int = 10_000) -> DataFrame:
    """(cycle, outcome, n): mean of each of `cycles` equal slices of the returns (seq_no, ret) in order; the last takes the rest.

    Rows are numbered within cells of `width` of seq_no, an integer, and offset by the cells before; their number is one broadcast row.
    """
    rows = running(rets.withColumn("_all", F.lit(0)), ["_all"], ["seq_no"], F.lit(1), "_i", width, how="sum")
    rows = rows.join(F.broadcast(rets.agg(F.count("*").alias("_n"))), F.lit(True))
    # slice c begins at floor(c * total / cycles); the last slice holding a row has the greatest such c
    slice_ = F.least(F.floor((F.col("_i") * cycles - 1) / F.col("_n")), F.lit(cycles - 1))
    return rows.groupBy(slice_.cast("int").alias("cycle")).agg(F.avg("ret").alias("outcome"), F.count("*").alias("n"))


def benchmarks(rets: DataFrame, assets: DataFrame, index_like: str = "510300") -> DataFrame:
    """(series, dt, ret): an index column, the equal-weight mean, and 60/40 from the first quarter end on.

    Quarters share their end dates, so a trading day that ends a quarter stands twice in the 60/40 series.
    """
    idx = assets.withColumn("n", F.count("*").over(W.partitionBy())).withColumn("hit", F.col("asset").contains(index_like))
    pick = idx.orderBy(F.desc("hit"), "asset_idx").limit(1).select("asset")
    hold = rets.join(F.broadcast(pick), "asset").select(F.lit("index_buy_hold").alias("series"), "dt", "ret")
    mean = rets.groupBy("dt").agg(F.avg("ret").alias("ret")).select(F.lit("equal_weight").alias("series"), "dt", "ret")
    n_stock = F.least(F.greatest(F.col("n") - 4, F.lit(2)), F.col("n") - 1)
    side = F.broadcast(idx.select("asset", (F.col("asset_idx") < n_stock).alias("stock")))
    parts = rets.join(side, "asset").groupBy("dt").agg(F.avg(F.when(F.col("stock"), F.col("ret"))).alias("s"), F.avg(F.when(~F.col("stock"), F.col("ret"))).alias("b"))
    span = rets.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"))
    ends = span.select("hi", F.explode(F.expr("sequence(date_trunc('quarter', lo), date_trunc('quarter', hi), interval 3 months)")).alias("q"))
    ends = ends.join(F.broadcast(span.select("lo")), F.lit(True)).select("hi", F.last_day(F.add_months("q", 2)).alias("start"), "lo").where("start between lo and hi")
    stop = F.coalesce(F.lead("start").over(W.orderBy("start")), F.col("hi"))
    mixed = parts.join(F.broadcast(ends.select("start", stop.alias("stop"))), F.col("dt").between(F.col("start"), F.col("stop")))
    return hold.unionByName(mean).unionByName(mixed.select(F.lit("sixty_forty").alias("series"), "dt", (0.6 * F.col("s") + 0.4 * F.col("b")).alias("ret")))
