"""The steps of a walk-forward run replayed as micro-batches: a callback gets every step once, in order, also over restarts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


class Replay:
    """Steps in `folder`: a file a step under `steps`, the stream's checkpoint under `at`, what was delivered under `log`.

    A step is delivered by calling deliver(step as a dict), and its row is then written to the log; a step whose row is there is not
    delivered again, whatever the stream repeats.  A callback that fails stops the stream before its step is logged, and the next run begins
    with that step.  Steps are few (schedule.MAX_STEPS at most), so the files are written one after the other, which is their order.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "step"):
        self.spark, self.folder, self.key = spark, folder, key

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def add(self, info: DataFrame) -> None:
        """Append steps; those that are there already stay as they are."""
        for row in sorted(info.collect(), key=lambda r: r[self.key]):
            path = f"{self.folder}/steps/{row[self.key]:06d}"
            if not self._there(path):
                self.spark.createDataFrame([row], info.schema).coalesce(1).write.mode("overwrite").parquet(path)

    def run(self, schema, deliver: Callable[[dict], None]) -> int:
        """Deliver all steps that are there and not yet delivered; returns their number."""
        given = 0

        def one(batch: DataFrame, _: int) -> None:
            nonlocal given
            for row in sorted(batch.collect(), key=lambda r: r[self.key]):
                path = f"{self.folder}/log/{row[self.key]:06d}"
                if not self._there(path):
                    deliver(row.asDict())
                    self.spark.createDataFrame([row], batch.schema).coalesce(1).write.mode("overwrite").parquet(path)
                    given += 1

        steps = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/steps/*")
        steps.writeStream.foreachBatch(one).option("checkpointLocation", f"{self.folder}/at").trigger(availableNow=True).start().awaitTermination()
        return given

    def log(self, schema, steps: list[int]) -> DataFrame:
        """The rows of those steps that were delivered."""
        done = [self.spark.read.schema(schema).parquet(p) for s in steps if self._there(p := f"{self.folder}/log/{s:06d}")]
        return reduce(DataFrame.unionByName, done) if done else self.spark.createDataFrame([], schema)
