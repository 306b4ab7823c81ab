"""Decision cycles of a walk-forward run: state, proposal, review by the whole rule file, arbitration, log.

Everything is a table by step: pools, proposals and reviews of all steps are made side by side in one plan.  They have a
row a step, asset and strategy at most (steps are bounded by schedule.MAX_STEPS), so they are cut to small tables once
and read again from there; the training returns, which are the large input, are read once for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.functions.stats import guarded
from tideglass.operators import backtest, checklist, decide, features, metrics, regime, strategies
from tideglass.sources.scratch import cut

#: What a run states about itself; schedule, samples, weights, turnover and evidence are computed.
FACTS = {
    "test_run_count": 1.0, "commission_rate": 0.00025, "min_commission": 5.0, "slippage_bps": 2.0, "impact_model": "sqrt",
    "rolling_expanding": True, "hmm_global_scaling": False, "strategy_pool_injectable": True, "survivorship_noted": True,
}
#: Steps with fewer training days take equal weights and are not logged.
LEAST = 30


def training_ends(train: DataFrame) -> DataFrame:
    """(step, decided, n_samples): the last training day and the number of days; one row a step."""
    return train.groupBy("step").agg(F.max("dt").alias("decided"), F.count_distinct("dt").alias("n_samples"))


def states(panel: DataFrame, ends: DataFrame, rets: DataFrame, n_states: int = 4) -> DataFrame:
    """(step, regime, sentiment) of (step, decided), known at that day: ranked regime (0 the worst) and trend sentiment.

    A step without a regime has 0, without sentiment 0.5: what a failed detector stands for.
    """
    mood = features.trend_sentiment(panel).withColumnRenamed("dt", "decided")
    rows = ends.select("step", "decided").join(regime.ranked(rets, ends, n_states), "step", "left").join(mood, "decided", "left")
    return rows.select("step", F.coalesce("regime", F.lit(0)).alias("regime"), F.coalesce(F.nanvl("sentiment", F.lit(0.5)), F.lit(0.5)).alias("sentiment"))


def proposals(state: DataFrame, pool: DataFrame, max_weight: float = 0.4) -> DataFrame:
    """(step, strategy, confidence, asset, w, fell_back): decide.propose, or equal weights without confidence.

    A strategy that could not be computed has a null or non-finite weight in its step; if it is the one chosen, the step falls back.
    """
    broken = F.bool_or(F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf")))
    failed = pool.groupBy("step", "strategy").agg(broken.alias("fell_back"))
    rows = decide.propose(state, pool, "step", max_weight).join(failed, ["step", "strategy"])
    even = 1 / F.count("*").over(W.partitionBy("step"))
    pick = lambda good, bad: F.when(F.col("fell_back"), bad).otherwise(good)
    return rows.select("step", pick(F.col("strategy"), F.lit("equal_weight")).alias("strategy"), pick(F.col("confidence"), F.lit(0.0)).alias("confidence"), "asset", pick(F.col("w"), even).alias("w"), "fell_back")


def evidence(train: DataFrame, proposal: DataFrame, n_trials: int) -> DataFrame:
    """(step, dsr_p_value): the deflated Sharpe test of each proposal over the days that it was trained on."""
    line = train.join(F.broadcast(proposal.select("step", "asset", "w")), ["step", "asset"])
    line = line.groupBy("step", "dt").agg(F.sum(F.col("ret") * F.col("w")).alias("ret"))
    stats = metrics.basics(line.withColumnRenamed("step", "series_id"))
    years = F.col("n") / F.col("ann")
    yearly = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / years) - 1).otherwise(-1.0)
    sharpe = guarded(yearly - 0.02, F.col("sd") * F.sqrt("ann"))
    found = metrics.deflated(stats.withColumn("sharpe", sharpe), F.col("sharpe"), F.greatest(years, F.lit(1.5)), n_trials)
    return found.select(F.col("series_id").alias("step"), "dsr_p_value")


def contexts(ends: DataFrame, steps: DataFrame, proposal: DataFrame, proof: DataFrame, step_months: int, embargo: int, facts: dict) -> DataFrame:
    """(step, confidence and the keys of decide.CONTEXT): what the rules are tested on; keys without a source stay null."""
    told = proposal.groupBy("step").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_list("w")).alias("weights"), F.bool_or("fell_back").alias("fell_back"))
    yearly = backtest.turnover(proposal).select("step", (F.col("turnover") * 12 / step_months).alias("annual_turnover"))
    rows = ends.select("step", F.col("decided").alias("train_end"), F.col("n_samples").cast("double").alias("n_samples"))
    rows = rows.join(F.broadcast(steps.select("step", "test_start")), "step").join(told, "step").join(yearly, "step", "left").join(proof, "step", "left")
    return rows.withColumns({"embargo_days": F.lit(float(embargo)), **{k: F.lit(v) for k, v in facts.items()}})


def run(panel: DataFrame, train: DataFrame, steps: DataFrame, rets: DataFrame, *, pool: DataFrame | None = None, state: DataFrame | None = None, items: DataFrame | None = None, facts: dict | None = None, n_assets: int | None = None, credit: float = 0.5, step_months: int = 3, embargo: int = 10) -> dict[str, DataFrame]:
    """Tables of a run's cycles: `log`, `decisions`, `proposals`, `findings`, `weights`.

    panel (dt, asset, price), its returns (dt, asset, ret) and the training returns (step, dt, asset, ret) of the steps.  Pool, state and items
    default to the built-in strategies, states() and the whole rule file; facts add to FACTS or replace them.

    Each stage has its fallback, listed in the log: a broken proposal goes equal and is approved unreviewed (`builder`, `critic`); a step
    without a review is approved (`critic`); a blend for another number of assets than n_assets keeps the proposal (`arbiter`).
    """
    spark = panel.sparkSession
    ends = cut(training_ends(train))
    logged = ends.where(F.col("n_samples") >= LEAST)
    pool = cut(strategies.pool(train) if pool is None else pool)
    state = cut(states(panel, logged, rets) if state is None else state)
    n_trials = pool.select("strategy").distinct().count()
    made = cut(proposals(state.join(logged.select("step"), "step"), pool))
    ctx = contexts(logged, steps, made, evidence(train, made, n_trials), step_months, embargo, FACTS | (facts or {}))
    ctx = cut(decide.contexts(ctx).select("step", "fell_back", *decide.CONTEXT))
    items = checklist.items(spark) if items is None else items
    reviewed = ctx.where("not fell_back")
    review = decide.review(items, reviewed, "step")
    settled = _settled(made, review, n_assets, credit)
    decisions = cut(settled)
    young = strategies.equal(train.join(F.broadcast(ends.where(F.col("n_samples") < LEAST).select("step")), "step"))
    return {
        "log": log(ends, decisions),
        "decisions": decisions,
        "proposals": made,
        "context": ctx,
        "findings": decide.findings(items, reviewed, "step"),
        "weights": decisions.select("step", "asset", "w").unionByName(young),
    }


def _settled(made: DataFrame, review: DataFrame, n_assets: int | None, credit: float) -> DataFrame:
    """(step, strategy, builder_confidence, asset, proposed, w, confidence, verdict, total_checks, passed, failed, critical_failures, fallbacks)."""
    found = made.select("step", "fell_back").distinct().join(review, "step", "left")
    found = found.withColumn("unread", F.col("verdict").isNull()).withColumn("verdict", F.coalesce("verdict", F.lit("APPROVE")))
    ruled = decide.arbitrate(made, found, credit).select("step", "asset", F.col("w").alias("settled"), F.col("confidence").alias("final"))
    misfit = (F.count("*").over(W.partitionBy("step")) != n_assets) & (F.col("verdict") == "DOWNGRADE") if n_assets is not None else F.lit(False)
    rows = made.drop("fell_back").withColumnRenamed("w", "proposed").join(ruled, ["step", "asset"]).join(found, "step").withColumn("misfit", misfit)
    names = F.filter(F.array(F.when(F.col("fell_back"), "builder"), F.when(F.col("unread"), "critic"), F.when(F.col("misfit"), "arbiter")), lambda x: x.isNotNull())
    pick = lambda bad, good: F.when(F.col("misfit"), bad).otherwise(F.col(good))
    counts = ("total_checks", "passed", "failed", "critical_failures")
    return rows.select("step", "strategy", F.col("confidence").alias("builder_confidence"), "asset", "proposed", pick(F.col("proposed"), "settled").alias("w"), pick(F.lit(0.1), "final").alias("confidence"), "verdict", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], names.alias("fallbacks"))


def log(ends: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row a cycle: step, decided, strategy, builder_confidence, verdict, final_confidence, counts of the review, fallbacks, weights by asset."""
    by = ["step", "strategy", "builder_confidence", "verdict", F.col("confidence").alias("final_confidence"), "total_checks", "passed", "failed", "critical_failures", "fallbacks"]
    rows = decisions.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "w")))).alias("weights"))
    return rows.join(ends.select("step", "decided"), "step").withColumnRenamed("step", "cycle")


def credited(log: DataFrame, line: DataFrame) -> DataFrame:
    """(cycle, strategy, verdict, outcome, builder, critic): each cycle's outcome and the credits after it.

    The curve's returns (seq_no, ret) are cut into as many slices as there are cycles; credits follow the cycles' order.  One row a cycle.
    """
    place = F.row_number().over(W.orderBy("cycle")) - 1
    told = log.select("cycle", "strategy", "verdict", place.alias("nth"))
    outcomes = backtest.cycle_outcomes(line, told.count()).withColumnRenamed("cycle", "nth")
    d = F.when(F.col("outcome") > 0, 0.01).otherwise(-0.01)
    rows = told.join(outcomes.select("nth", "outcome"), "nth", "left").withColumn("outcome", F.coalesce("outcome", F.lit(0.0))).withColumn("d", d)
    seen = F.transform(F.array_sort(F.collect_list(F.struct("nth", "d")).over(W.orderBy("nth"))), lambda x: x.d)
    held = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    walk = lambda sign: F.aggregate(seen, F.lit(0.5), lambda a, x: held(a + sign * x))
    return rows.select("cycle", "strategy", "verdict", "outcome", walk(1).alias("builder"), walk(-1).alias("critic"))
