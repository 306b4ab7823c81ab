"""Atomic checkpoints of the control loop: tasks, log tail, quota and index under one manifest.

A version is a manifest file that names the tables written for it.  Tables go to folders of their own first; the manifest is written under
another name and renamed last, without overwriting, so a version is there whole or not at all, and of two writers that started from the
same version the second one is told.  Manifests that cannot be read are passed over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the log that a checkpoint keeps.
TAIL = 100


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all manifests, torn ones included."""
    fs, folder = _fs(spark, path), f"{path}/manifests"
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))] if fs.exists(_path(spark, folder)) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict | None:
    """The manifest, or None if it is gone or torn."""
    place = _path(spark, f"{path}/manifests/v{version}.json")
    if not _fs(spark, path).exists(place):
        return None
    stream = _fs(spark, path).open(place)
    try:
        found = json.loads(bytes(stream.readAllBytes()).decode("utf-8", "replace"))
    except ValueError:
        return None
    finally:
        stream.close()
    return found if isinstance(found, dict) and found.get("version") == version else None


def latest(spark: SparkSession, path: str) -> int:
    """The newest version that can be read; 0 if there is none."""
    return next((v for v in reversed(versions(spark, path)) if _manifest(spark, path, v)), 0)


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], facts: dict, base: int | None = None, max_versions: int = 5) -> int:
    """Write the version after `base` (the newest one if not given); raises Conflict if that is there already.

    All but the newest max_versions are deleted, their tables too; what a failed writer left stays out of every manifest.
    """
    fs, have = _fs(spark, path), versions(spark, path)
    base = (have[-1] if have else 0) if base is None else base
    version = base + 1
    if have and have[-1] >= version:
        raise Conflict(f"version {have[-1]} is there already")
    places = {}
    for name, df in tables.items():
        places[name] = [f"data/{uuid.uuid4().hex}", df.schema.json()]
        df.write.parquet(f"{path}/{places[name][0]}")
    fs.mkdirs(_path(spark, f"{path}/manifests"))
    own, final = _path(spark, f"{path}/manifests/.{uuid.uuid4().hex}"), _path(spark, f"{path}/manifests/v{version}.json")
    out = fs.create(own, False)
    out.write(bytearray(json.dumps({"version": version, "facts": facts, "tables": places}).encode()))
    out.close()
    try:
        options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(own, final, options)
    except Exception as e:
        fs.delete(own, False)
        for place, _ in places.values():
            fs.delete(_path(spark, f"{path}/{place}"), True)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version} is there already") from e
        raise
    for old in versions(spark, path)[:-max_versions]:
        for place, _ in (_manifest(spark, path, old) or {"tables": {}})["tables"].values():
            fs.delete(_path(spark, f"{path}/{place}"), True)
        fs.delete(_path(spark, f"{path}/manifests/v{old}.json"), False)
    return version


def restore(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict, dict[str, DataFrame]] | None:
    """(version, facts, tables) of the given version or the newest that can be read; None if there is none."""
    from pyspark.sql.types import StructType

    version = latest(spark, path) if version is None else version
    found = _manifest(spark, path, version)
    if not found:
        return None
    read = lambda place, schema: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/{place}")
    return version, found["facts"], {n: read(*x) for n, x in found["tables"].items()}


def tail(log: DataFrame, order: list[str], n: int = TAIL) -> DataFrame:
    """The newest n rows of the log."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)


def merged(live: DataFrame, saved: DataFrame, key: str, defaults: dict[str, Column | None]) -> DataFrame:
    """live with the columns of `defaults` as saved: where the save has a row but no value, the default, or the live value if that is None.

    Rows that only one side has stay as they are live, or are dropped; of rows that the save repeats, one counts.
    """
    names = [n for n in defaults if n in saved.columns]
    mine = saved.dropDuplicates([key]).select(F.col(key), F.struct(*names).alias("_saved"))
    rows = live.join(mine, key, "left")
    found = F.col("_saved").isNotNull()
    value = lambda n: F.when(found, F.coalesce(F.col(f"_saved.{n}"), F.col(n) if defaults[n] is None else defaults[n].cast(live.schema[n].dataType.simpleString()))).otherwise(F.col(n))
    return rows.select(*[value(c).alias(c) if c in names else F.col(c) for c in live.columns])
