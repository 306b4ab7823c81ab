"""Incremental forms of the control loop for Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACTIONS = "key string, seq long, gain double, low_run int, action string"


def _action(gain: float, run: int, stop_after: int) -> str:
    if gain >= 20:
        return "continue"
    if gain >= 10:
        return "continue_low_freq"
    if gain >= 5:
        return "mark_risk"
    return "force_stop" if run >= stop_after else "switch_strategy"


def gain_actions(stream: DataFrame, stop_after: int = 3, looped: bool = False) -> DataFrame:
    """(key, seq, gain) to actions, the run of low gains kept per key: one number of state a key.

    With `looped`, a gain below 5 ends the run, as the strategy is switched or the task stopped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        for part in parts:
            rows = []
            for seq, gain in part.sort_values("seq")[["seq", "gain"]].itertuples(index=False):
                run = 0 if gain >= 10 else run + 1
                rows.append((key[0], seq, gain, run, _action(gain, run, stop_after)))
                run = 0 if looped and gain < 5 else run
            yield pd.DataFrame(rows, columns=["key", "seq", "gain", "low_run", "action"])
        state.update((run,))

    return stream.groupBy("key").applyInPandasWithState(step, ACTIONS, "low_run int", "append", GroupStateTimeout.NoTimeout)


def eg_weights(stream: DataFrame, eta: float = 0.1) -> DataFrame:
    """Running sums by strategy, the state of exponentiated gradient; weights are their softmax at the sink."""
    return stream.groupBy("strategy").agg(F.sum("ret").alias("total")).withColumn("score", F.exp(eta * F.col("total")))


def quota(stream: DataFrame, hours: int = 5, limit: int = 1000, delay: str = "10 minutes") -> DataFrame:
    """Calls by tumbling window with late rows up to `delay`, and how many the quota rejects."""
    rows = stream.withWatermark("ts", delay).groupBy(F.window("ts", f"{hours} hours").alias("w")).agg(F.count("*").alias("calls"))
    return rows.select(F.col("w.start").alias("window_start"), "calls", F.greatest(F.col("calls") - limit, F.lit(0)).alias("rejected"))


def fresh(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the delay: a cache with a time to live."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
