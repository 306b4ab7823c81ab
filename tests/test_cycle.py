"""Decision cycles: each stage's fallback, young steps, the log against a plain loop, ranked regimes, credit, the report."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import backtest, checklist, cycle, decide, regime, report, schedule, strategies

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def made(spark):
    """Three assets, two steps of 60 training days and one of 10."""
    rng = np.random.RandomState(3)
    rows = [(s, DAY + dt.timedelta(i + 40 * s), a, float(rng.randn() * 0.01 + 0.001)) for s, n in ((0, 60), (1, 60), (2, 10)) for i in range(n) for a in "abc"]
    train = spark.createDataFrame(rows, "step int, dt date, asset string, ret double")
    ends = {s: max(r[1] for r in rows if r[0] == s) for s in range(3)}
    steps = spark.createDataFrame([(s, e + dt.timedelta(10 if s else 3)) for s, e in ends.items()], "step int, test_start date")
    prices = spark.createDataFrame([(DAY + dt.timedelta(i), a, 100.0 + i) for i in range(140) for a in "abc"], "dt date, asset string, price double")
    return train, steps, prices


def _state(spark, *rows):
    return spark.createDataFrame(list(rows), "step int, regime int, sentiment double")


def _run(spark, made, state, **more):
    train, steps, prices = made
    rets = schedule.step_returns(prices.select(F.lit(0).alias("step"), F.lit("x").alias("side"), "dt", "asset", "price")).select("dt", "asset", "ret")
    return cycle.run(prices, train, steps, rets, state=state, **more)


def test_rule_file_is_whole():
    assert len(checklist.ITEMS) == 65
    assert len({m for m, _ in checklist.ITEMS}) == 14


def test_log_verdicts_and_young_steps(spark, made):
    found = _run(spark, made, _state(spark, (0, 3, 0.9), (1, 0, 0.9), (2, 3, 0.5)))
    log = {r.cycle: r for r in found["log"].collect()}
    # step 2 has too few days: equal weights and no entry
    assert set(log) == {0, 1}
    assert {r.asset: pytest.approx(1 / 3) for r in found["weights"].where("step = 2").collect()} == {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}
    # the test of step 0 starts 3 days after its training ends: the purge rule is critical
    assert (log[0].strategy, log[0].verdict, log[0].final_confidence, log[0].critical_failures) == ("momentum", "REJECT", 0.1, 1)
    assert all(v == pytest.approx(1 / 3) for v in log[0].weights.values())
    assert (log[1].strategy, log[1].verdict, log[1].builder_confidence, log[1].final_confidence) == ("defensive", "DOWNGRADE", 0.6, pytest.approx(0.36))
    assert all(r.total_checks == 65 and r.passed + r.failed == 65 and r.fallbacks == [] for r in log.values())
    # 60 days of 3 assets fail the two rules on the number of samples
    failed = {r.check for r in found["findings"].where("step = 1 and not passed").collect()}
    assert len([c for c in failed if "PBO" in c]) == 2


def test_plain_review_equals_findings(spark, made):
    """Every item of a reviewed step once, its own rule's outcome."""
    found = _run(spark, made, _state(spark, (0, 3, 0.5), (1, 3, 0.5)))
    ctx = {r.step: r for r in found["context"].collect()}
    want = {"setting": set()}
    for r in found["findings"].collect():
        c = ctx[r.step]
        if r.marker == "SHORT" and "40%" in r.check:
            assert r.passed == (max(c.weights) <= 0.4)
        elif r.marker == "COST" and "换手率" in r.check:
            assert r.passed == ((c.annual_turnover or 0) <= 3)
        elif r.marker in ("META", "OUTLIER", "STORY", "GLOBAL"):
            assert r.passed
        elif r.marker == "SNOOPING" and "Deflated" in r.check:
            assert r.passed == (c.dsr_p_value < 0.05)
        want["setting"].add((r.step, r.item_no))
    assert len(want["setting"]) == 130


def test_broken_proposal_falls_back(spark, made):
    train = made[0]
    bad = strategies.pool(train).withColumn("w", F.when(F.expr("strategy = 'momentum' and step = 0 and asset = 'b'"), F.lit(None)).otherwise(F.col("w")))
    log = {r.cycle: r for r in _run(spark, made, _state(spark, (0, 3, 0.9), (1, 3, 0.9)), pool=bad)["log"].collect()}
    assert (log[0].strategy, log[0].builder_confidence, log[0].verdict, log[0].fallbacks) == ("equal_weight", 0.0, "APPROVE", ["builder", "critic"])
    assert all(v == pytest.approx(1 / 3) for v in log[0].weights.values())
    assert (log[1].strategy, log[1].fallbacks) == ("momentum", [])


def test_review_without_rules_is_approved(spark, made):
    none = spark.createDataFrame([], "item_no int, marker string, check string")
    log = _run(spark, made, _state(spark, (0, 3, 0.5), (1, 3, 0.5)), items=none)["log"].collect()
    assert [(r.verdict, r.fallbacks, round(r.final_confidence, 9)) for r in log] == [("APPROVE", ["critic"], 0.525)] * 2


def test_blend_for_another_number_of_assets(spark, made):
    found = _run(spark, made, _state(spark, (0, 3, 0.5), (1, 3, 0.5)), n_assets=9)
    rows = found["decisions"].where("step = 1").collect()
    assert all(r.fallbacks == ["arbiter"] and r.confidence == 0.1 and r.w == pytest.approx(r.proposed) for r in rows)
    assert {tuple(r.fallbacks) for r in found["decisions"].where("step = 0").collect()} == {()}


def test_missing_state_is_the_worst_one(spark, made):
    train, steps, prices = made
    ends = cycle.training_ends(train)
    rows = cycle.states(prices.limit(0), ends, prices.selectExpr("dt", "asset", "price as ret").limit(0)).collect()
    assert {(r.regime, r.sentiment) for r in rows} == {(0, 0.5)}


def test_ranked_regimes_equal_a_loop(spark):
    rng = np.random.RandomState(7)
    x = rng.randn(120) * 0.01
    days = [DAY + dt.timedelta(i) for i in range(120)]
    rets = spark.createDataFrame([(d, a, float(v)) for d, v in zip(days, x) for a in "ab"], "dt date, asset string, ret double")
    at = {0: 10, 1: 19, 2: 50, 3: 119}
    ends = spark.createDataFrame([(s, days[i]) for s, i in at.items()], "step int, decided date")
    mean = [np.round(x[i - 19 : i + 1].mean(), 12) for i in range(19, 120)]
    want = {s: int(4 * sum(m < mean[i - 19] for m in mean[: i - 18]) // (i - 18)) for s, i in at.items() if i >= 19}
    assert {r.step: r.regime for r in regime.ranked(rets, ends).collect()} == want


def test_credit_of_cycles_equals_a_loop(spark):
    line = [0.01, -0.02, 0.03, 0.01, -0.01, -0.02, 0.05]
    log = spark.createDataFrame([(c, "m", "APPROVE") for c in (4, 7, 9)], "cycle int, strategy string, verdict string")
    got = cycle.credited(log, spark.createDataFrame(list(enumerate(line)), "seq_no int, ret double")).orderBy("cycle").collect()
    slices = [line[0:2], line[2:4], line[4:7]]
    b = 0.5
    for r, part in zip(got, slices):
        b += 0.01 if np.mean(part) > 0 else -0.01
        assert (r.outcome, r.builder, r.critic) == (pytest.approx(np.mean(part)), pytest.approx(b), pytest.approx(1 - b))


def test_short_paths_are_skipped(spark):
    prices = spark.createDataFrame([(DAY + dt.timedelta(i), a, 100.0 + i + (i % 3)) for i in range(36) for a in "ab"], "dt date, asset string, price double")
    # groups of 6 days: what stays of a training group is cut by purge and embargo, so some paths keep fewer than 20 days
    counts = {r.path: r.n for r in schedule.cpcv_members(prices).where("side = 'train'").groupBy("path").agg(F.count_distinct("dt").alias("n")).collect()}
    long = {p for p, n in counts.items() if n >= 20}
    assert {r.path for r in backtest.cpcv_sharpes(prices, strategies.equal).collect()} == long


def test_report_lines():
    record = {"annual_return": 0.1, "sharpe": 1.0, "deflated_sharpe": 0.6, "dsr_p_value": 0.2, "sortino": 1.5, "calmar": 0.5, "max_drawdown": -0.2, "max_dd_duration_days": 30.0, "win_rate": 0.55, "profit_factor": 1.2, "pbo": 0.6, "warnings": ["pbo", "dsr"], "conclusion": "positive"}
    out = report.lines(record, {"approved": 1, "downgraded": 2, "rejected": 0}, [{"strategy": "m", "quarters": 3, "share_pct": 100.0}], [{"series": "x", "cagr_pct": 4.0}], 1.5, {"n_paths": 15, "mean_sharpe": 0.5, "std_sharpe": 0.1, "pct_positive": 0.8})
    assert "against x: +6.00% (+4.00%)" in out
    assert "CPCV paths: 15, positive: 80%" in out
    assert [x for x in out if x.startswith("warning")] == ["warning: pbo", "warning: dsr"]
    assert out[-1] == "positive"
    assert "CPCV" not in " ".join(report.lines(record, {"approved": 0, "downgraded": 0, "rejected": 0}, [], [], 0.0, {"n_paths": 0}))
