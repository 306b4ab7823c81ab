"""The registered queries do the whole job of the reference's schedules and state counts."""

import numpy as np

from tideglass.operators import backtest, regime
from tideglass.plans import registry

SF = "/root/testdata/sf0.001"


def test_regimes_and_sweep_are_monthly(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(regime, "fits", lambda features, steps, least, most: seen.update(steps=steps, states=(least, most)) or features.select("dt"))
    monkeypatch.setattr(backtest, "sweep", lambda panel, weigh, grid: seen.update(grid=grid) or panel)
    monkeypatch.setattr(regime, "select_states", lambda f, steps, least=2, most=6: regime.fits(f, steps, least, most))
    registry.QUERIES["regimes"](spark, SF)
    registry.QUERIES["sweep"](spark, SF)
    ends = [r.train_end for r in seen["steps"].orderBy("step").collect()]
    assert len(ends) > 30 and sorted((b - a).days for a, b in zip(ends, ends[1:]))[len(ends) // 2] < 40 and seen["states"] == (2, 6)
    assert {(g["purge"], g["step_months"]) for g in seen["grid"]} == {(a, b) for a in (3, 5, 10) for b in (1, 3)}


def test_blocked_recursions_equal_plain_ones():
    rng = np.random.RandomState(3)
    for n, k in ((1, 2), (2, 2), (17, 3), (230, 6)):
        b, move, start = np.exp(-30 * rng.rand(n, k)), rng.rand(k, k) ** 8, np.full(k, 1 / k)
        move /= move.sum(1, keepdims=True)
        alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
        for t in range(n):
            a = (alpha[t - 1] @ move if t else start) * b[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        got = regime.passes(b, start, move)
        assert np.allclose(got[0], alpha) and np.allclose(got[1], beta, rtol=1e-6) and np.allclose(got[2], scale)
