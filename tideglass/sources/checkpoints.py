"""Versioned checkpoints of a table: write, read the latest or a given version, keep the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version=") and n.partition("=")[2].isdigit())


def save(df: DataFrame, path: str, max_versions: int = 10) -> int:
    """Write the next version and drop all but the newest `max_versions`; returns its number."""
    spark = df.sparkSession
    have = versions(spark, path)
    new = (have[-1] if have else 0) + 1
    df.write.json(f"{path}/version={new}")
    for old in [*have, new][:-max_versions]:
        fs, p = _fs(spark, f"{path}/version={old}")
        fs.delete(p, True)
    return new


def load(spark: SparkSession, path: str, version: int | None = None, schema=None) -> DataFrame | None:
    """The latest or the given version; None when there is none."""
    have = versions(spark, path)
    if not have or (version is not None and version not in have):
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(f"{path}/version={version or have[-1]}")
