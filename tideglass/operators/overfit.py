"""Overfitting statistics of a strategy matrix (strategy_id, obs, ret)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_masks(n_obs: int, n_splits: int = 100, seed: int = 42) -> list[tuple[int, list[int]]]:
    """(split, in-sample observations): shuffled observations cut at a random place in [n/3, 2n/3)."""
    rng = np.random.RandomState(seed)
    out = []
    for s in range(n_splits):
        order = np.arange(n_obs)
        rng.shuffle(order)
        cut = rng.randint(n_obs // 3, 2 * n_obs // 3)
        out.append((s, sorted(order[:cut].tolist())))
    return out


def pbo(matrix: DataFrame, n_splits: int = 100, seed: int = 42) -> DataFrame:
    """One row (pbo, n_splits): share of splits whose best in-sample strategy ranks in the lower half out of sample.

    0.5 with fewer than 2 strategies or 10 observations.  Splits are the only small table made on the
    driver; sums by split, side and strategy are grouped aggregates.
    """
    spark = matrix.sparkSession
    n = matrix.agg(F.count_distinct("strategy_id").alias("s"), F.count_distinct("obs").alias("o")).first()
    if n.s < 2 or n.o < 10:
        return spark.createDataFrame([(0.5, 0)], "pbo double, n_splits int")
    masks = spark.createDataFrame(split_masks(n.o, n_splits, seed), "split int, inside array<int>")
    rows = matrix.crossJoin(F.broadcast(masks)).withColumn("is_in", F.array_contains("inside", F.col("obs")))
    ratio = lambda c: F.avg(F.when(c, F.col("ret"))) / F.greatest(F.stddev_pop(F.when(c, F.col("ret"))), F.lit(1e-10))
    score = rows.groupBy("split", "strategy_id").agg(ratio(F.col("is_in")).alias("a"), ratio(~F.col("is_in")).alias("b"))
    best = score.groupBy("split").agg(F.max_by("b", F.struct("a", -F.col("strategy_id"))).alias("best_b"))
    over = score.join(best, "split").groupBy("split").agg(F.count_if(F.col("b") > F.col("best_b")).alias("above"))
    return over.agg(F.avg((F.col("above") >= n.s // 2).cast("double")).alias("pbo"), F.count("*").cast("int").alias("n_splits"))


def effective_trials(matrix: DataFrame, most: int = 20) -> DataFrame:
    """One row (n_trials): clusters of the strategies by correlation distance, Ward linkage, best silhouette.

    Distances are one grouped self-join; at most a hundred strategies are clustered in one group.
    """
    x = matrix.select("obs", F.col("strategy_id").alias("i"), F.col("ret").alias("x"))
    y = matrix.select("obs", F.col("strategy_id").alias("j"), F.col("ret").alias("y"))
    corr = F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y"))
    d = x.join(y, "obs").groupBy("i", "j").agg((1 - F.abs(F.coalesce(corr, F.lit(0.0)))).alias("d")).withColumn("g", F.lit(0))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = g.pivot(index="i", columns="j", values="d").to_numpy()
        return pd.DataFrame({"n_trials": [clusters(m, most)]})

    return d.groupBy("g").applyInPandas(run, "n_trials int")


def ward(d: np.ndarray) -> list[list[int]]:
    """Labels after each merge, from n clusters to one, by Lance-Williams updates of squared distances."""
    n = len(d)
    sq = d.astype(float) ** 2
    np.fill_diagonal(sq, np.inf)
    size, alive, label = np.ones(n), list(range(n)), list(range(n))
    out = [list(label)]
    while len(alive) > 1:
        sub = sq[np.ix_(alive, alive)]
        a, b = divmod(int(sub.argmin()), len(alive))
        i, j = alive[min(a, b)], alive[max(a, b)]
        for k in alive:
            if k not in (i, j):
                total = size[i] + size[j] + size[k]
                sq[i, k] = sq[k, i] = ((size[i] + size[k]) * sq[i, k] + (size[j] + size[k]) * sq[j, k] - size[k] * sq[i, j]) / total
        size[i] += size[j]
        alive.remove(j)
        label = [i if x == j else x for x in label]
        out.append(list(label))
    return out


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    values = np.zeros(len(d))
    for p in range(len(d)):
        own = (label == label[p]) & (np.arange(len(d)) != p)
        if own.any():
            a = d[p, own].mean()
            b = min(d[p, label == c].mean() for c in set(label.tolist()) - {label[p]})
            values[p] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return float(values.mean())


def clusters(d: np.ndarray, most: int = 20) -> int:
    """Number of clusters, 2 to `most`, of the best silhouette; 1 with fewer than 3 items."""
    n = len(d)
    if n < 3:
        return 1 if n < 2 else n
    labels = ward(d)
    best, out = -1.0, 1
    for k in range(2, min(n - 1, most) + 1):
        s = silhouette(d, np.array(labels[n - k]))
        if s > best:
            best, out = s, k
    return out
