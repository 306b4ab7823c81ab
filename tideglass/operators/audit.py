"""Look-ahead and quality audits over a run's tables: (check_id, phase, passed, detail), one row a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _row(df: DataFrame, check: str, phase: str, passed, detail) -> DataFrame:
    """One aggregated row; an empty table passes."""
    return df.agg(F.coalesce(passed, F.lit(True)).alias("passed"), detail.cast("string").alias("detail")).select(F.lit(check).alias("check_id"), F.lit(phase).alias("phase"), "passed", "detail")


def interval_audits(intervals: DataFrame) -> DataFrame:
    """A1: at least 3 days from train end to test start; A5: a test ends before the next one starts."""
    gap = F.min(F.datediff("test_start", "train_end"))
    a1 = _row(intervals, "A1", "1A", gap >= 3, gap)
    after = intervals.withColumn("next_start", F.lead("test_start").over(W.orderBy("step"))).where("next_start is not null")
    a5 = _row(after, "A5", "1A", F.bool_and(F.col("test_end") < F.col("next_start")), F.count_if(F.col("test_end") >= F.col("next_start")))
    return a1.unionByName(a5)


def embargo_audit(log: DataFrame) -> DataFrame:
    """A2: each embargo starts where the last test ended."""
    same = F.col("embargo_start") == F.col("prev_test_end")
    return _row(log, "A2", "1A", F.bool_and(same), F.count_if(~same))


def fit_audits(history: DataFrame, intervals: DataFrame) -> DataFrame:
    """A3, A4: no fit (of the model, of its scaler) ends after any train end."""
    first = intervals.agg(F.min("train_end").alias("first_end"))
    rows = history.crossJoin(F.broadcast(first))
    out = None
    for check, c in (("A3", "fit_end"), ("A4", "scaler_fit_end")):
        late = F.col(c) > F.col("first_end")
        part = _row(rows, check, "1A", F.bool_and(~late), F.count_if(late))
        out = part if out is None else out.unionByName(part)
    return out


def signal_audit(signals: DataFrame) -> DataFrame:
    """A6: at least a day from one signal's computation to the next one's application."""
    one = signals.select("step", "compute_date", "apply_date").distinct()
    rows = one.withColumn("next_apply", F.lead("apply_date").over(W.orderBy("step"))).where("next_apply is not null")
    gap = F.min(F.datediff("next_apply", "compute_date"))
    return _row(rows, "A6", "1A", gap >= 1, gap)


def quality_audits(facts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Checks B and D over each row of facts, with its keys; a missing fact fails its check."""
    tests = [
        ("B1", "1B", "stamp_duty > 0 and commission_rate >= 0.00025 and slippage_bps >= 2"),
        ("B2", "1B", "n_steps >= 3"),
        ("B3", "1B", "n_strategies >= 2 and max_weight_corr < 0.7"),
        ("B4", "1B", "seed_sharpe_std < 0.3"),
        ("B5", "1B", "grid_sharpe_range < 0.5"),
        ("D1", "3", "dsr_p_value < 0.05"),
        ("D2", "3", "pbo < 0.3"),
        ("D3", "3", "sensitivity_done"),
        ("D4", "3", "cpcv_positive > 0.5"),
        ("D5", "3", "sharpe < 2.5"),
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("check_id"), F.lit(p).alias("phase"), F.coalesce(F.expr(e), F.lit(False)).alias("passed"), F.lit(e).alias("detail")) for c, p, e in tests])
    return facts.select(*keys, F.inline(rows))


def gate(results: DataFrame, order: tuple[str, ...] = ("1A", "1B", "2", "3")) -> DataFrame:
    """The results of the phases up to and with the first that fails."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("phase"))
    rows = results.withColumn("_p", place)
    stop = rows.where("not passed").agg(F.min("_p").alias("_stop"))
    return rows.crossJoin(F.broadcast(stop)).where("_stop is null or _p <= _stop").drop("_p", "_stop")


def phase_totals(results: DataFrame) -> DataFrame:
    return gate(results).groupBy("phase").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"))


def run_audits(run: dict[str, DataFrame]) -> DataFrame:
    """A1, A2, A5 and A6 of a back-test's tables."""
    log = run["embargo"].join(run["steps"].select("step", "prev_test_end"), "step")
    parts = [interval_audits(run["steps"]), embargo_audit(log), signal_audit(run["signals"])]
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_metrics(rets: DataFrame) -> DataFrame:
    """One row: n, Sharpe without a risk-free rate, total return and volatility in percent, from (seq_no, ret)."""
    total = (F.exp(F.sum(F.log1p("ret"))) - 1) * 100
    sharpe = F.when(F.stddev_samp("ret") > 0, F.avg("ret") / F.stddev_samp("ret") * 252**0.5).otherwise(0.0)
    return rets.agg(F.count("ret").alias("n"), sharpe.alias("sharpe"), total.alias("total_return_pct"), (F.stddev_samp("ret") * 252**0.5 * 100).alias("volatility_pct"))


def trust_context(run: dict[str, DataFrame]) -> DataFrame:
    """One row of what the checks read: n_steps, intervals (one a step), embargoes, signals, and the curve's metrics in percent.

    The metrics are null where returns do not vary.  A run has at most 100 steps, a row each.
    """
    from tideglass.operators import backtest

    steps = run["steps"].agg(F.count("*").alias("n_steps"), F.sort_array(F.collect_list(F.struct("step", "train_end", "test_start", "test_end"))).alias("intervals"))
    logs = [run[t].agg(F.count("*").alias(n)) for t, n in (("embargo", "n_embargoes"), ("signals", "n_signals"))]
    so_far = W.orderBy("step", "seq").rowsBetween(W.unboundedPreceding, 0)
    fall = run["equity"].select((F.col("equity") / F.max("equity").over(so_far) - 1).alias("f")).agg((F.min("f") * 100).alias("max_drawdown_pct"))
    found = run_metrics(backtest.equity_returns(run["equity"])).crossJoin(fall)
    varies = F.col("volatility_pct") > 0
    found = found.select(*[F.when(varies, F.col(c)).alias(c) for c in ("sharpe", "total_return_pct", "volatility_pct", "max_drawdown_pct")])
    return reduce(lambda a, b: a.crossJoin(b), [*logs, found], steps)
