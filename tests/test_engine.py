"""Invariants and golden values of the panel engine."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.functions.stats import trade_cost
from tideglass.operators import audit, control, decide, metrics, overfit, schedule
from tideglass.plans import registry
from tideglass.sources import checkpoints
from tideglass.sources.tables import rule_items, synthetic_panel

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_golden_schedule(spark):
    steps = schedule.walk_forward(synthetic_panel(spark)).orderBy("step").collect()
    assert len(steps) == 12
    d = dt.date
    assert (steps[0].train_end, steps[0].test_start, steps[0].test_end, steps[0].n_train, steps[0].n_test) == (d(2023, 1, 2), d(2023, 1, 9), d(2023, 4, 10), 780, 66)
    assert (steps[11].train_end, steps[11].test_end, steps[11].n_train, steps[11].n_test) == (d(2025, 10, 1), d(2025, 12, 31), 1497, 62)
    assert all((s.test_start - s.train_end).days >= 5 for s in steps)


@pytest.mark.parametrize(("value", "volume", "cost"), [(100, None, 10.09), (10_000, None, 19.0), (100_000, None, 140.0), (100_000, 1e8, 143.162278), (5_000_000, 1e8, 8118.033989)])
def test_cost_points(spark, value, volume, cost):
    v = F.lit(volume) if volume else None
    assert spark.range(1).select(trade_cost(F.lit(float(value)), v)).first()[0] == pytest.approx(cost, abs=1e-6)


def test_toy_record(spark):
    toy = [0.01, -0.02, 0.015, 0.0, -0.005, 0.03, -0.01, 0.02]
    s = spark.createDataFrame([("t", dt.date(2024, 1, 1) + dt.timedelta(i), r) for i, r in enumerate(toy)], "series_id string, dt date, ret double")
    r = metrics.record(s).first()
    assert r.total_return == pytest.approx(0.0397026802)
    assert r.period_vol == pytest.approx(0.0166904592)
    assert r.kurtosis == pytest.approx(2.0928994083)
    assert (r.max_drawdown, r.max_dd_duration_days, r.win_rate) == (pytest.approx(-0.02), 4, 0.5)
    assert r.var_95 == pytest.approx(-0.0165)
    assert r.profit_factor == pytest.approx(2.1428571429)


def test_pbo_equals_loop(spark):
    rng = np.random.RandomState(5)
    m = rng.randn(6, 60) * 0.01
    matrix = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(60)], "strategy_id int, obs int, ret double")
    bad = 0
    for _, inside in overfit.split_masks(60):
        out = [k for k in range(60) if k not in set(inside)]
        ratio = lambda x: x.mean(1) / np.maximum(x.std(1), 1e-10)
        a, b = ratio(m[:, inside]), ratio(m[:, out])
        bad += (b > b[a.argmax()]).sum() >= 3
    assert overfit.pbo(matrix).first().pbo == pytest.approx(bad / 100)


def test_clusters_planted():
    d = np.full((9, 9), 1.0)
    for g in range(3):
        d[g * 3 : g * 3 + 3, g * 3 : g * 3 + 3] = 0.1
    np.fill_diagonal(d, 0)
    assert overfit.clusters(d) == 3


def test_gain_actions(spark):
    r = spark.createDataFrame([("a", i, float(g)) for i, g in enumerate([35, 7, 3, 4, 2, 12, 3])], "task string, seq int, gain double")
    got = [x.action for x in control.gain_actions(r, "task", "seq").orderBy("seq").collect()]
    assert got == ["continue", "mark_risk", "switch_strategy", "force_stop", "force_stop", "continue_low_freq", "switch_strategy"]


def test_review_and_rules(spark, tmp_path):
    f = tmp_path / "rules.md"
    f.write_text("# rules [LOOKAHEAD]\n- [ ] Purging 5 days\n- [ ] Embargo 10 days\n## costs [COST]\n- [ ] 滑点 2bp\n- [ ] 佣金\n", encoding="utf-8")
    items = rule_items(spark, str(f))
    assert items.count() == 4
    d = dt.date
    ctx = spark.createDataFrame([(1, d(2024, 1, 1), d(2024, 1, 11), 10.0, 0.8), (2, d(2024, 1, 1), d(2024, 1, 2), 10.0, 0.8), (3, d(2024, 1, 1), d(2024, 1, 11), 0.0, 0.8)], "cycle int, train_end date, test_start date, embargo_days double, confidence double")
    got = {r.cycle: (r.verdict, r.adjusted_confidence) for r in decide.review(items, ctx).collect()}
    assert got == {1: ("APPROVE", 0.8), 2: ("REJECT", 0.0), 3: ("DOWNGRADE", pytest.approx(0.64))}


def test_eg_closed_form(spark):
    rets = np.array([0.05, -0.02, 0.01, 0.0])
    df = spark.createDataFrame([(t, str(i), float(r)) for t in range(50) for i, r in enumerate(rets)], "t int, strategy string, ret double")
    w = np.full(4, 0.25)
    for _ in range(50):
        w = w * np.exp(0.1 * rets)
        w /= w.sum()
    got = decide.eg_weights(df).where("t = 49").orderBy("strategy").collect()
    assert np.allclose([r.w for r in got], w)


def test_eg_weights_stay_finite_where_exp_overflows(spark):
    df = spark.createDataFrame([(1, "a", 7090.0), (1, "b", 7089.0), (2, "a", 3000.0), (2, "b", 3000.0), (2, "c", 10_000.0)], "t int, strategy string, ret double")
    got = {(r.t, r.strategy): r.w for r in decide.eg_weights(df).collect()}
    a = np.exp([0.0, -0.1, -9.0])
    assert np.allclose([got[1, "a"], got[1, "b"]], a[:2] / a[:2].sum())
    b = np.exp(np.array([1009.0, 1008.9, 1000.0]) - 1009.0)
    assert np.allclose([got[2, "a"], got[2, "b"], got[2, "c"]], b / b.sum())


def test_means_halfway_between_tenths_go_to_the_even_one(spark):
    # 19.65 exactly, while a sum of doubles gives 19.650000000000002
    items = [("a", s, 1.0) for s in (36.24, 3.7, 21.32, 17.34)] + [("b", float("nan"), 1.0), ("c", 1e300, 1.0), ("c", 1e300, 1.0), ("d", None, 1.0)]
    df = spark.createDataFrame(items, "k string, score double, weight double").selectExpr("*", "'range' as scoring_mode", "0.5 as min_score")
    for rows in (df, df.orderBy("score"), df.orderBy(F.desc("score"))):
        got = {r.k: r.score for r in control.weighted_scores(rows, "k").where("k <> 'b'").collect()}
        assert got == {"a": 19.6, "c": 1e300, "d": None}


def test_gate_stops(spark):
    r = spark.createDataFrame([("A1", "1A", True, ""), ("B1", "1B", False, ""), ("D1", "3", True, "")], "check_id string, phase string, passed boolean, detail string")
    assert sorted(x.check_id for x in audit.gate(r).collect()) == ["A1", "B1"]


def test_checkpoint_versions(spark, tmp_path):
    path = str(tmp_path / "c")
    for i in range(4):
        checkpoints.save(spark.createDataFrame([("t", i)], "id string, score int"), path, max_versions=2)
    assert checkpoints.versions(spark, path) == [3, 4]
    assert checkpoints.load(spark, path).first().score == 3
    assert checkpoints.load(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("name", ["panel_build", "metrics_basic", "gain_actions", "text_sentiment", "health_score"])
def test_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
