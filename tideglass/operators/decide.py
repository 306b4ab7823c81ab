"""Decision rules: proposals, rule-table review, arbitration, online credit, exponentiated gradient.

Rules are data: a table of (marker, words, context key, test, limit), joined to the rule file's items by marker;
the first rule whose words are in an item decides it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.operators.ordered import before_each, running
from tideglass.sources.scratch import cut

BEAR = ("BEAR", "0", "HIGH_VOL")
#: Outcomes that credit() folds in one array.
CHUNK = 1024
# Words that make a failed item critical.
CRITICAL = ["前视偏差", "Purging", "全局", "过拟合"]

# Fixed values: (marker, any of these words, all of these words, none of these words, check).
RULES: list[tuple[str, list[str], list[str], list[str], str]] = [
    ("LOOKAHEAD", ["purging", "purge"], [], [], "purge_gap"),
    ("LOOKAHEAD", ["embargo"], [], [], "embargo"),
    ("LOOKAHEAD", [], ["HMM", "全局"], [], "no_global_scaling"),
    ("LOOKAHEAD", ["扩窗", "滚动"], [], [], "expanding"),
    ("SHORT", [">= 0", "做空"], [], [], "long_only"),
    ("SHORT", ["= 1", "满仓", "权重和"], [], [], "fully_invested"),
    ("SHORT", ["40%", "上限", "单标"], [], [], "capped"),
    ("SPLIT", [], ["测试集", "1 次"], [], "one_test_run"),
    ("SPLIT", ["样本"], [], [], "enough_samples"),
    ("SPLIT", ["日志"], [], [], "dates_logged"),
    ("CLEAN", ["样本"], [], [], "enough_samples"),
    ("COST", ["佣金"], [], ["最低"], "commission"),
    ("COST", ["最低佣金"], [], [], "min_commission"),
    ("COST", ["滑点"], [], [], "slippage"),
    ("COST", ["冲击成本", "非线性"], [], [], "impact"),
    ("COST", ["换手率"], [], [], "turnover"),
    ("MODEL_EVAL", ["BIC", "AIC"], [], [], "bic"),
    ("MODEL_EVAL", ["扩窗", "滚动"], [], [], "expanding"),
    ("OVERFIT", ["Deflated Sharpe", "DSR"], [], [], "dsr"),
    ("OVERFIT", ["PBO"], [], [], "pbo"),
    ("OVERFIT", ["参数敏感性", "参数搜索"], [], [], "sensitivity"),
    ("SNOOPING", ["PBO"], [], [], "pbo"),
    ("SNOOPING", ["Deflated Sharpe", "p-value"], [], [], "dsr"),
    ("SNOOPING", ["测试集"], [], [], "one_test_run"),
    ("SURVIVOR", [], [], [], "survivorship"),
    ("E2E", [], ["日志", "train_end"], [], "dates_logged"),
    ("E2E", ["策略池"], [], [], "pool_injectable"),
]


def _get(key: str, default, kind: str) -> Column:
    return F.coalesce(F.col(key).cast(kind), F.lit(default).cast(kind))


def checks() -> dict[str, Column]:
    """Each check as a predicate over a context row; missing values take their defaults."""
    number = lambda k, d: _get(k, d, "double")
    flag = lambda k, d: _get(k, d, "boolean")
    dates = F.col("train_end").isNotNull() & F.col("test_start").isNotNull()
    w = F.coalesce("weights", F.array().cast("array<double>"))
    return {
        "purge_gap": F.coalesce(F.datediff("test_start", "train_end") >= 5, F.lit(False)),
        "embargo": number("embargo_days", 0) >= 10,
        "no_global_scaling": ~flag("hmm_global_scaling", False),
        "expanding": flag("rolling_expanding", True),
        "long_only": F.forall(w, lambda x: x >= 0),
        "fully_invested": F.abs(F.aggregate(w, F.lit(0.0), lambda a, x: a + x) - 1) < 0.01,
        "capped": F.coalesce(F.array_max(w) <= 0.4, F.lit(True)),
        "one_test_run": number("test_run_count", 0) <= 1,
        "enough_samples": number("n_samples", 0) >= 200,
        "dates_logged": dates,
        "commission": number("commission_rate", 0.00025) >= 0.00025,
        "min_commission": number("min_commission", 5) >= 5,
        "slippage": number("slippage_bps", 2) >= 2,
        "impact": _get("impact_model", "", "string").isin("sqrt", "almgren-chriss"),
        "turnover": number("annual_turnover", 0) <= 3,
        "bic": flag("hmm_bic_recorded", False),
        "dsr": number("dsr_p_value", 1) < 0.05,
        "pbo": number("pbo_value", 1) < 0.3,
        "sensitivity": flag("sensitivity_done", False),
        "survivorship": flag("survivorship_noted", False),
        "pool_injectable": flag("strategy_pool_injectable", True),
    }


CONTEXT = {
    "train_end": "date", "test_start": "date", "weights": "array<double>", "confidence": "double", "embargo_days": "double", "hmm_global_scaling": "boolean",
    "rolling_expanding": "boolean", "test_run_count": "double", "n_samples": "double", "commission_rate": "double", "min_commission": "double", "slippage_bps": "double",
    "impact_model": "string", "annual_turnover": "double", "hmm_bic_recorded": "boolean", "dsr_p_value": "double", "pbo_value": "double", "sensitivity_done": "boolean",
    "survivorship_noted": "boolean", "strategy_pool_injectable": "boolean",
}


def contexts(rows: DataFrame) -> DataFrame:
    """Context rows with every known key, those that are missing as nulls of their type."""
    return rows.withColumns({c: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind) for c, kind in CONTEXT.items()})


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "priority int, r_marker string, any_of array<string>, all_of array<string>, none_of array<string>, rule string")


def items_with_rules(items: DataFrame) -> DataFrame:
    """(item_no, marker, check, rule): the first matching rule of the item's marker, null for none (the item then passes)."""
    rules = F.broadcast(rule_table(items.sparkSession))
    # a word of the rules is met as it stands or in lower case
    holds = lambda w: F.contains(F.col("check"), w) | F.contains(F.lower("check"), w)
    has = lambda a: F.exists(a, holds)
    match = ((F.size("any_of") == 0) | has("any_of")) & F.forall("all_of", holds) & ~has("none_of")
    joined = items.join(rules, (F.col("marker") == F.col("r_marker")) & match, "left")
    return joined.groupBy("item_no", "marker", "check").agg(F.min_by("rule", "priority").alias("rule"))


def findings(items: DataFrame, ctx: DataFrame, key: str = "cycle") -> DataFrame:
    """(key, item_no, marker, check, passed) of every context row against every item; items are a small rule file."""
    table = checks()
    verdicts = F.map_from_arrays(F.array(*[F.lit(k) for k in table]), F.array(*table.values()))
    rows = contexts(ctx).select(key, "confidence", verdicts.alias("v"))
    joined = rows.join(F.broadcast(items_with_rules(items)), F.lit(True))
    return joined.select(key, "confidence", "item_no", "marker", "check", F.coalesce(F.try_element_at("v", F.col("rule")), F.lit(True)).alias("passed"))


def review(items: DataFrame, ctx: DataFrame, key: str = "cycle") -> DataFrame:
    """(key, verdict, adjusted_confidence, total_checks, passed, failed, critical_failures)."""
    critical = F.exists(F.array(*[F.lit(w) for w in CRITICAL]), lambda w: F.contains(F.col("check"), w))
    found = findings(items, ctx, key).groupBy(key).agg(
        F.first("confidence", ignorenulls=True).alias("c"),
        F.count("*").alias("total_checks"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(~F.col("passed") & critical).alias("critical_failures"),
    )
    c = F.coalesce("c", F.lit(0.5))
    bad, many, some = F.col("critical_failures") > 0, F.col("failed") >= 3, F.col("failed") > 0
    verdict = F.when(bad, "REJECT").when(some, "DOWNGRADE").otherwise("APPROVE")
    conf = F.when(bad, 0.0).when(many, c * 0.5).when(some, c * 0.8).otherwise(c)
    return found.select(key, verdict.alias("verdict"), conf.alias("adjusted_confidence"), "total_checks", "passed", "failed", "critical_failures")


def propose(state: DataFrame, pool: DataFrame, key: str = "step", max_weight: float = 0.4) -> DataFrame:
    """(key, strategy, confidence, asset, w) from state (key, regime, sentiment) and the pool's weights (key, strategy, asset, w).

    Bear regimes and sentiment below 0.3 go defensive, above 0.6 momentum, else risk parity; a strategy that the
    pool lacks is replaced by the pool's first.  Weights are clipped to max_weight, then normalised.
    """
    bear = F.col("regime").cast("string").isin(*BEAR) | (F.col("sentiment") < 0.3)
    want = F.when(bear, "defensive").when(F.col("sentiment") > 0.6, "momentum").otherwise("risk_parity")
    conf = F.when(bear, 0.6).when(F.col("sentiment") > 0.6, 0.8).otherwise(0.7)
    have = pool.groupBy(key).agg(F.collect_set("strategy").alias("names"), F.min("strategy").alias("first"))
    chosen = state.join(have, key).select(key, F.when(F.array_contains("names", want), want).otherwise(F.col("first")).alias("strategy"), conf.alias("confidence"))
    rows = pool.join(chosen, [key, "strategy"]).withColumn("raw", F.least(F.greatest("w", F.lit(0.0)), F.lit(max_weight)))
    all_ = W.partitionBy(key)
    w = F.when(F.sum("raw").over(all_) > 0, F.col("raw") / F.sum("raw").over(all_)).otherwise(1 / F.count("*").over(all_))
    return rows.select(key, "strategy", "confidence", "asset", w.alias("w"))


def arbitrate(proposal: DataFrame, verdicts: DataFrame, credit: float = 0.5, key: str = "step") -> DataFrame:
    """(key, asset, w, confidence, verdict): rejected go equal, downgraded are blended with equal, approved stay."""
    all_ = W.partitionBy(key)
    even = 1 / F.count("*").over(all_)
    v = F.col("verdict")
    raw = F.when(v == "REJECT", even).when(v == "DOWNGRADE", 0.7 * F.col("w") + 0.3 * even).otherwise(F.col("w"))
    conf = F.when(v == "REJECT", 0.1).when(v == "DOWNGRADE", F.col("confidence") * 0.6).otherwise(F.col("confidence") * (0.5 + 0.5 * credit))
    rows = proposal.join(verdicts.select(key, "verdict"), key).withColumn("raw", raw).withColumn("confidence", conf)
    return rows.select(key, "asset", (F.col("raw") / F.sum("raw").over(all_)).alias("w"), "confidence", "verdict")


def _held(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def _after(a: list[float], b: list[float]) -> list[float]:
    """First a, then b: clamped steps (shift, low, high), two of them side by side."""
    return [v for i in (0, 3) for v in (a[i] + b[i], _held(a[i + 1] + b[i], b[i + 1], b[i + 2]), _held(a[i + 2] + b[i], b[i + 1], b[i + 2]))]


def credit(outcomes: DataFrame, by: str = "agent_set", order: str = "seq", start: float = 0.5, step: float = 0.01, last: int = 8, width: int = CHUNK) -> DataFrame:
    """(by, builder, critic, history): the clamped credit walk over each group's outcomes in order, an integer that tells them apart.

    Steps clamped to [0, 1] compose: any run of them is x -> clamp(x + shift, low, high).  So chunks of `width` numbers of
    the order are folded apart, then level upon level; no group is sorted or gathered whole.
    """
    kind = "struct<shift:double,low:double,high:double>"
    triple = lambda s, l, h: F.struct(s.alias("shift"), l.alias("low"), h.alias("high"))  # noqa: E731, E741
    none = triple(F.lit(0.0), F.lit(float("-inf")), F.lit(float("inf"))).cast(kind)
    held = lambda x, l, h: F.least(F.greatest(x, l), h)  # noqa: E731, E741
    # the clamp of one step: it moves by d, then stays within 0 and 1
    one = lambda a, d: triple(a.shift + d, held(a.low + d, F.lit(0.0), F.lit(1.0)), held(a.high + d, F.lit(0.0), F.lit(1.0)))
    d = F.when(F.col("outcome") > 0, step).otherwise(-step)
    parts = outcomes.groupBy(by, F.floor(F.col(order) / width).alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), d.alias("d")))), lambda x: x.d).alias("o"))
    fold = lambda sign: F.aggregate("o", none, lambda a, x: one(a, sign * x))
    parts = parts.select(by, "c", fold(1).alias("b"), fold(-1).alias("k"))
    v = F.array("b.shift", "b.low", "b.high", "k.shift", "k.low", "k.high")
    parts = cut(parts.select(by, "c", v.alias("v")))
    ends = parts.join(before_each(parts, [by], _after), [by, "c"]).groupBy(by).agg(F.max_by("v", "c").alias("v"), F.max_by("before", "c").alias("before"))
    at = lambda i: held(F.coalesce(held(F.lit(start) + F.col("before")[i], F.col("before")[i + 1], F.col("before")[i + 2]), F.lit(start)) + F.col("v")[i], F.col("v")[i + 1], F.col("v")[i + 2])
    walk = ends.select(by, at(0).alias("builder"), at(3).alias("critic"))
    return walk.join(latest(outcomes, by, order, "outcome", last).withColumnRenamed("latest", "history"), by)


def latest(rows: DataFrame, by: str, order: str, value: str, n: int) -> DataFrame:
    """(by, latest): each group's last n values in order."""
    newest = rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= n)
    return newest.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).alias("v")))), lambda x: x.v).alias("latest"))


def eg_weights(returns: DataFrame, eta: float = 0.1, by: tuple[str, ...] = (), width: int = 10_000) -> DataFrame:
    """(by..., t, strategy, w) of (by..., t, strategy, ret): multiplicative updates in closed form.

    After t updates from even weights, w is the softmax of eta times the summed returns; t is an integer, summed in cells of `width`.
    """
    rows = running(returns, [*by, "strategy"], ["t"], F.col("ret"), "_sum", width, how="sum")
    rows = rows.select(*by, "t", "strategy", (eta * F.col("_sum")).alias("s"))
    now = W.partitionBy(*by, "t")
    rows = rows.withColumn("e", F.exp(F.col("s") - F.max("s").over(now)))
    return rows.select(*by, "t", "strategy", (F.col("e") / F.sum("e").over(now)).alias("w"))


def eg_portfolio(strategy_weights: DataFrame, pool: DataFrame, key: str = "step") -> DataFrame:
    """(key, asset, w): the pool's weights mixed by the strategies' weights, negative ones cut, normalised."""
    rows = pool.join(strategy_weights.withColumnRenamed("w", "sw"), [key, "strategy"]).groupBy(key, "asset").agg(F.greatest(F.sum(F.col("sw") * F.col("w")), F.lit(0.0)).alias("raw"))
    all_ = W.partitionBy(key)
    w = F.when(F.sum("raw").over(all_) > 0, F.col("raw") / F.sum("raw").over(all_)).otherwise(1 / F.count("*").over(all_))
    return rows.select(key, "asset", w.alias("w"))
