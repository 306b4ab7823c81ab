"""Helpers of the corpus operators: tables, shared scratch tables, bounded joins."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.sources.scratch import shared_dir

#: Rows of a table of ids (8 bytes each) that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of text worked on at once inside a Python worker.
SLICE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(it: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of one is small."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batched(spark: SparkSession, rows: int = 500):
    """Bound the rows that go to Python workers at once in the jobs that run inside; the session's setting comes back."""
    before = spark.conf.get(_ROWS, None)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROWS)
        else:
            spark.conf.set(_ROWS, before)


_STAGES: ContextVar[tuple[Stage, ...]] = ContextVar("stages", default=())


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Python workers get at most `rows` rows at once.  The caller owns the table: drop() deletes it, Scratch those of one
    operator, and an open Stage all that are written in its block.
    """
    path = new_path(df.sparkSession, name)
    for owner in _STAGES.get():
        owner.paths.append(path)
    if rows:
        with batched(df.sparkSession, rows):
            df.write.parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete a table written by keep()."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete(df.sparkSession, f)


class Scratch:
    """The tables of one operator: deleted when its block ends, by an error too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())

    def folder(self, name: str) -> str:
        """A path of its own for files that tasks write themselves."""
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def keep(self, df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
        path = self.folder(name)
        df.write.options(**(options or {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


class Stage(Scratch):
    """Owner of every table that keep() writes while its block runs, results of operators included; those given to outlive() stay."""

    def __enter__(self) -> Stage:
        self._before = _STAGES.set((*_STAGES.get(), self))
        return self

    def __exit__(self, *error) -> None:
        _STAGES.reset(self._before)
        super().__exit__(*error)

    def outlive(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that an outer stage or the caller owns: it may read this stage's tables, which go when the block ends."""
        out = keep(df, name)
        self.paths.pop()
        return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of short rows, marked for broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names made of `names` that are none of `taken`, however they are spelled."""
    mark = "_"
    while {f"{mark}{n}".lower() for n in names} & {t.lower() for t in taken}:
        mark += "_"
    return [f"{mark}{n}" for n in names]


def semi(df: DataFrame, ids: DataFrame, key: str, anti: bool = False, rows: int | None = None) -> DataFrame:
    """df's rows whose key is (not) in ids; ids is broadcast only if its counted rows are few."""
    rows = ids.count() if rows is None else rows
    ids = F.broadcast(ids) if rows <= BROADCAST_ROWS else ids
    return df.join(ids, key, "left_anti" if anti else "left_semi")


def lean(run):
    """A worker's generator that hands freed memory back when its task ends, as workers are used again."""

    @functools.wraps(run)
    def wrapped(it):
        try:
            yield from run(it)
        finally:
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return wrapped


def crc_mod(key: str, n: int):
    """crc32 of the id written as text, modulo n (null ids: null)."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % n
