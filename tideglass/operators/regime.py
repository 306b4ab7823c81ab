"""Regimes by Gaussian hidden Markov models: one group a (step, number of states), fitted in numpy.

The only Python in the panel plans besides custom strategies: Baum-Welch has no relational form.  A
group is one training window of features, a few thousand rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAMES = ("ret_1d", "ret_5d", "ret_20d", "vol_20d", "max_corr", "spread")


def passes(b: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, scale) of the scaled forward and backward recursions; b are the emissions of each row.

    The rows are cut into about sqrt(n) blocks that are worked side by side: each block's product of
    transitions (rows normalised, their logs in `size`) gives the vectors at its ends.
    """
    n, k = b.shape
    long = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // long)
    step = np.tile(np.eye(k), (blocks * long, 1, 1))
    step[1:n] = move * b[1:, None, :]
    step = step.reshape(blocks, long, k, k).swapaxes(0, 1).copy()
    product, size = np.tile(np.eye(k), (blocks, 1, 1)), np.zeros((blocks, k))
    for j in range(long):
        product = product @ step[j]
        rows = np.maximum(product.sum(2), 1e-300)
        product /= rows[:, :, None]
        size += np.log(rows)
    first = max((start * b[0]).sum(), 1e-300)
    ahead = np.empty((blocks, k))
    ahead[0] = start * b[0] / first
    for i in range(1, blocks):
        log = np.log(np.maximum(ahead[i - 1], 1e-300)) + size[i - 1]
        a = np.exp(log - log.max()) @ product[i - 1]
        ahead[i] = a / max(a.sum(), 1e-300)
    alpha, scale = np.empty((long, blocks, k)), np.empty((long, blocks))
    a = ahead
    for j in range(long):
        a = (a[:, None, :] @ step[j])[:, 0]
        scale[j] = np.maximum(a.sum(1), 1e-300)
        a = a / scale[j][:, None]
        alpha[j] = a
    behind = np.ones((blocks, k))
    for i in range(blocks - 1, 0, -1):
        log = np.log(np.maximum(product[i] @ behind[i], 1e-300)) + size[i]
        # alpha and beta of a row multiply to 1 in sum
        whole = np.log(np.maximum(alpha[-1, i - 1], 1e-300)) + log
        top = whole.max()
        behind[i - 1] = np.exp(np.minimum(log - top - np.log(np.exp(whole - top).sum()), 690))
    beta = np.empty((long, blocks, k))
    a = behind
    for j in range(long - 1, -1, -1):
        beta[j] = a
        a = (step[j] @ a[:, :, None])[:, :, 0] / scale[j][:, None]
    flat = lambda x: x.swapaxes(0, 1).reshape(blocks * long, *x.shape[2:])[:n]
    scale = flat(scale)
    scale[0] = first
    return flat(alpha), flat(beta), scale


def fit(x: np.ndarray, states: int, rounds: int = 200, seed: int = 42, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """(Viterbi path, log likelihood) of a diagonal Gaussian model of standardised x."""
    n, dim = x.shape
    rng = np.random.RandomState(seed)
    # spread-out starting means, then Lloyd rounds
    mean = x[[int(rng.randint(n))]]
    while len(mean) < states:
        gap = ((x[:, None] - mean[None]) ** 2).sum(2).min(1)
        mean = np.vstack((mean, x[int(gap.argmax())]))
    for _ in range(20):
        near = ((x[:, None] - mean[None]) ** 2).sum(2).argmin(1)
        mean = np.array([x[near == s].mean(0) if (near == s).any() else mean[s] for s in range(states)])
    var = np.array([x[near == s].var(0) if (near == s).sum() > 1 else x.var(0) for s in range(states)]) + 1e-3
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    before = -np.inf
    for _ in range(rounds):
        like = -0.5 * (((x[:, None] - mean) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1))
        top = like.max(1, keepdims=True)
        b = np.exp(like - top)
        alpha, beta, scale = passes(b, start, move)
        total = float(np.log(scale).sum() + top.sum())
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        xi = (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None])) * move
        start = gamma[0]
        move = xi / np.maximum(xi.sum(1, keepdims=True), 1e-300)
        weight = np.maximum(gamma.sum(0), 1e-10)[:, None]
        mean = gamma.T @ x / weight
        var = np.maximum(gamma.T @ (x * x) / weight - mean**2, 0) + 1e-3
        if total - before < tol:
            break
        before = total
    like = -0.5 * (((x[:, None] - mean) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1))
    log_move = np.log(np.maximum(move, 1e-300))
    v, back = np.log(np.maximum(start, 1e-300)) + like[0], np.zeros((n, states), int)
    for t in range(1, n):
        way = v[:, None] + log_move
        back[t] = way.argmax(0)
        v = way.max(0) + like[t]
    path = np.empty(n, int)
    path[-1] = v.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, total


def detect(frame: pd.DataFrame, states: int) -> tuple[np.ndarray, float]:
    """(states relabelled by rising mean ret_1d, BIC); fewer than 5 rows a state is an error."""
    if len(frame) < 5 * states:
        raise ValueError("too few rows for the states")
    x = frame[list(NAMES)].to_numpy(float)
    sd = x.std(0)
    path, total = fit((x - x.mean(0)) / np.where(sd > 0, sd, 1), states)
    rets = frame["ret_1d"].to_numpy(float)
    mean = [rets[path == s].mean() if (path == s).any() else -1e10 for s in range(states)]
    rank = np.argsort(np.argsort(mean, kind="stable"), kind="stable")
    return rank[path], -2 * total + (states**2 - 1 + 2 * states * x.shape[1]) * np.log(len(x))


def fits(features: DataFrame, steps: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """(step, n_states, bic, state, n_obs, fit_start, fit_end, occupancy) of every step and number of states.

    Features look back only, so a step's history is the rows up to its train end; steps are broadcast.
    """
    counts = F.explode(F.sequence(F.lit(least), F.lit(most)))
    wanted = F.broadcast(steps.select("step", "train_end", counts.alias("n_states")))
    rows = features.join(wanted, F.col("dt") <= F.col("train_end")).drop("train_end")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt")
        k = int(g.n_states.iloc[0])
        columns = ["step", "n_states", "bic", "state", "n_obs", "fit_start", "fit_end", "occupancy"]
        try:
            path, bic = detect(g, k)
        except ValueError:
            return pd.DataFrame(columns=columns)
        seen = {str(s): int((path == s).sum()) for s in range(k)}
        return pd.DataFrame([[int(g.step.iloc[0]), k, float(bic), int(path[-1]), len(g), g.dt.iloc[0], g.dt.iloc[-1], seen]], columns=columns)

    kinds = "step int, n_states int, bic double, state int, n_obs int, fit_start date, fit_end date, occupancy map<string,int>"
    return rows.groupBy("step", "n_states").applyInPandas(run, kinds)


def select_states(features: DataFrame, steps: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """The fit of least BIC of each step; ties go to fewer states."""
    best = F.min_by(F.struct("n_states", "bic", "state", "n_obs", "fit_start", "fit_end", "occupancy"), F.struct("bic", "n_states"))
    return fits(features, steps, least, most).groupBy("step").agg(best.alias("f")).select("step", "f.*")


def ranked(rets: DataFrame, ends: DataFrame, n_states: int = 4, window: int = 20) -> DataFrame:
    """(step, regime) of (step, decided): the market's mean return of the last `window` days, ranked in its history up to that day.

    State 0 holds the lowest n-th of the history, as the fitted model's states rise with their mean return; steps whose day has no full
    window are absent.  One row a trading day meets one row a step, which is broadcast.
    """
    line = W.orderBy("dt")
    mean = rets.groupBy("dt").agg(F.avg("ret").alias("m"))
    # rounded, so that a day equals itself whatever the order of its sums
    r = F.when(F.row_number().over(line) >= window, F.round(F.avg("m").over(line.rowsBetween(-(window - 1), 0)), 12))
    days = mean.select("dt", r.alias("r")).where("r is not null")
    now = days.join(F.broadcast(ends.select("step", "decided")), F.col("dt") == F.col("decided")).select("step", "decided", F.col("r").alias("now"))
    seen = days.join(F.broadcast(now), F.col("dt") <= F.col("decided"))
    below = seen.groupBy("step").agg(F.count_if(F.col("r") < F.col("now")).alias("k"), F.count("*").alias("n"))
    return below.select("step", F.floor(F.col("k") * n_states / F.col("n")).cast("int").alias("regime"))
