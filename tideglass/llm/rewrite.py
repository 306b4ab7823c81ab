"""Rewrite of a table whose files drifted in schema, in key order: an external merge sort and a rewrite by manifest.

1. `spill`: every input partition is sorted by (crc32 of the id, id, hash of the row) and written as a run.
2. `cuts`: the exact rows that begin a file.  Their place is narrowed down by counts: by the upper 12 bits of the hash (4,097
   counts at most), by whole hash values within the buckets that hold a cut, then by key and run among the rows of that
   hash value.  Only the cuts themselves (one a file) reach the driver, and they are all that tasks are sent.
3. `slices`: every run's range of rows for every file.
4. `merged`: a task merges the slices of its file by a heap, a small batch of each at a time, and writes the file as it goes.  More
   than FAN_IN slices are merged in rounds, each round dealt over tasks by file and group of runs.
5. `rewritten`: tasks follow the manifest of files, match columns by Parquet field id and write drifted files anew under the
   next generation's name; only once the manifest of all of them is written are superseded files deleted, by the tasks that
   read the final files back.

Rows that equal each other in all columns may change places without effect, so reruns give equal files however the
input is partitioned.  Files appear by a rename (see files.py) and tables of facts are Spark tables, so lost executors only
repeat tasks.

Cases: a null client_id sorts first and reads `?`; repeated ids are ordered by a hash of their rows; NaN and infinite balances are
spelled nan, inf and -inf; very long texts are rows like others; an empty table has no files; further columns are
ignored, and so is the case of column names.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.llm.files import published, remove, store
from tideglass.llm.shared import Scratch, delete, keep, new_path

#: The evolved schema: name and type, in the order of the Parquet field ids 1 to 10.
EVOLVED = [
    ("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("updated_at", pa.timestamp("us")), ("name", pa.string()),
    ("email", pa.string()), ("city", pa.string()), ("nation_id", pa.int64()), ("segment", pa.string()), ("balance", pa.float64()),
]
#: What stands in rows of files that lack a column.
MISSING = {"nation_id": -1, "segment": "none"}
#: Files that the table is cut into at most.
FILES = 250
#: Slices that one task merges at once; rows of each that it holds; rows it writes at once.
FAN_IN, HELD, WRITTEN = 256, 512, 4096
#: Bytes of a run's row groups, the unit in which slices are read.
GROUP = 1 << 18
_LEAST = -(1 << 63)
_ID = b"PARQUET:field_id"


def version_of(file_no: int) -> int:
    v = zlib.crc32(f"19:{file_no}".encode()) % 24
    return 0 if v > 15 else v


def schema_of(version: int) -> pa.Schema:
    """The schema of a starting file: the evolved one, drifted by the version's bits; field ids stay with the data."""
    fields = [[name, kind, i + 1] for i, (name, kind) in enumerate(EVOLVED)]
    by = {f[0]: f for f in fields}
    if version & 8:
        by["balance"][1], by["nation_id"][1] = pa.float32(), pa.int32()
    if version & 1:
        by["name"][0], by["email"][0] = "email", "name"
    if version & 4:
        fields = [f for f in fields if f[0] not in MISSING]
    if version & 2:
        fields[1:] = fields[:0:-1]
    return pa.schema([pa.field(name, kind, True, {_ID: str(i).encode()}) for name, kind, i in fields])


def _field_id(field: pa.Field) -> int:
    return int(field.metadata[_ID])


# --- runs and cuts -------------------------------------------------------------------------------------------------


def spill(table: DataFrame, scratch: Scratch) -> DataFrame:
    """The sorted runs of table as a kept table, with their file and row: columns of EVOLVED, _crc, _id, _h, _run, _row."""
    sql = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double", pa.timestamp("us"): "timestamp_ntz"}
    rows = table.select(*[F.col(name).cast(sql[kind]).alias(name) for name, kind in EVOLVED])
    crc = F.coalesce(F.crc32(F.encode(F.col("client_id").cast("string"), "UTF-8")), F.lit(-1))
    rows = rows.select("*", crc.alias("_crc"), F.coalesce("client_id", F.lit(_LEAST)).alias("_id"), F.xxhash64(*rows.columns).alias("_h"))
    runs = scratch.keep(rows.sortWithinPartitions("_crc", "_id", "_h"), "runs", {"parquet.block.size": GROUP})
    return runs.select("*", F.col("_metadata.file_path").alias("_run"), F.col("_metadata.row_index").alias("_row"))


def _ranked(counts: DataFrame, wanted: list[tuple], group: str, order: list[str]) -> list:
    """The rows of counts (with n) in which the wanted (cut, group, rank within the group) fall; `rest` is the rank within that row."""
    spark = counts.sparkSession
    line = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0)))
    cuts = F.broadcast(spark.createDataFrame(wanted, f"cut int, {group} long, rank long"))  # one row a file
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    return counts.join(cuts, group).where(inside).withColumn("rest", F.col("rank") - F.col("before")).collect()


def cuts(runs: DataFrame, files: int = FILES) -> tuple[int, list[tuple]]:
    """(number of rows, sorted (crc, id, hash, run, row) of the rows that begin the second and each later file)."""
    top = F.shiftright("_crc", 20)
    counts = sorted((r.b, r.n) for r in runs.groupBy(top.alias("b")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    size = 1 + total // files
    ends = np.cumsum([n for _, n in counts])
    wanted = []
    for cut, rank in enumerate(range(size, total, size)):
        i = int(np.searchsorted(ends, rank, "right"))
        wanted.append((cut, counts[i][0], int(rank - ends[i] + counts[i][1])))
    if not wanted:
        return total, []
    some = runs.where(top.isin(sorted({b for _, b, _ in wanted}))).groupBy(top.cast("long").alias("b"), "_crc").agg(F.count("*").alias("n"))
    wanted = [(r.cut, r._crc, r.rest) for r in _ranked(some, wanted, "b", ["_crc"])]
    some = runs.where(F.col("_crc").isin(sorted({c for _, c, _ in wanted})))
    some = some.groupBy("_crc", "_id", "_h", "_run").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    found = _ranked(some, wanted, "_crc", ["_id", "_h", "_run"])
    return total, sorted((r._crc, r._id, r._h, r._run, r.first + r.rest) for r in found)


def slices(runs: DataFrame, begins: list[tuple]) -> DataFrame:
    """(file_no, run, low, high): the rows of every run that belong into every file."""
    crcs = np.array([c[0] for c in begins], np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            crc, paths, row = batch.column("_crc").to_numpy(), batch.column("_run"), batch.column("_row").to_numpy()
            file_no = np.searchsorted(crcs, crc, "right")
            # rows that share a cut's hash value are compared with the whole cut
            for i in np.flatnonzero(np.searchsorted(crcs, crc, "left") != file_no).tolist():
                file_no[i] = bisect.bisect_right(begins, (int(crc[i]), batch.column("_id")[i].as_py(), batch.column("_h")[i].as_py(), paths[i].as_py(), int(row[i])))
            name = paths.dictionary_encode()
            code = name.indices.to_numpy()
            edge = np.flatnonzero((np.diff(file_no) != 0) | (np.diff(code) != 0)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(row)]))
            yield pa.RecordBatch.from_arrays([pa.array(file_no[starts]), name.dictionary.take(pa.array(code[starts])), pa.array(row[starts]), pa.array(row[ends - 1] + 1)], ["file_no", "run", "low", "high"])

    found = runs.select("_crc", "_id", "_h", "_run", "_row").mapInArrow(run, "file_no long, run string, low long, high long")
    return found.groupBy("file_no", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))


# --- merging -------------------------------------------------------------------------------------------------------


def _rows(path: str, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """The rows low to high of a run, in small batches, read from the row groups that hold them."""
    system, place = store(path)
    with system.open_input_file(place) as f:
        run = pq.ParquetFile(f)
        sizes = [run.metadata.row_group(i).num_rows for i in range(run.num_row_groups)]
        ends = np.cumsum(sizes)
        first, last = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left"))
        at = int(ends[first] - sizes[first])
        for batch in run.iter_batches(batch_size=HELD, row_groups=list(range(first, min(last, len(sizes) - 1) + 1))):
            a, b = max(low - at, 0), min(high - at, batch.num_rows)
            at += batch.num_rows
            if a < b:
                yield batch.slice(a, b - a)


def merge(parts: list[tuple[str, int, int]]) -> Iterator[pa.Table]:
    """The rows of sorted slices (run, low, high) in order, WRITTEN at a time: a heap holds the next row of every slice."""
    held: dict[tuple[int, int], pa.RecordBatch] = {}

    def keys(s: int) -> Iterator[tuple]:
        for b, batch in enumerate(_rows(*parts[s])):
            held[s, b] = batch
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_crc", "_id", "_h")))):
                yield *key, s, b, i

    def table(rows: list[tuple]) -> pa.Table:
        spans: dict[tuple[int, int], list[int]] = {}
        for *_, s, b, i in rows:
            spans.setdefault((s, b), [i, i])[1] = i + 1
        start, at = {}, 0
        for k, (a, e) in spans.items():
            start[k] = at - a
            at += e - a
        every = pa.Table.from_batches([held[k].slice(a, e - a) for k, (a, e) in spans.items()])
        out = every.take(pa.array([start[s, b] + i for *_, s, b, i in rows]))
        latest: dict[int, int] = {}
        for s, b in held:
            latest[s] = max(b, latest.get(s, 0))
        for k in [k for k in held if k[1] < latest[k[0]]]:
            del held[k]
        return out

    buffer: list[tuple] = []
    for row in heapq.merge(*map(keys, range(len(parts)))):
        buffer.append(row)
        # a stream's older batches are given up on writing, so rows of them never stay behind
        if len(buffer) == WRITTEN:
            yield table(buffer)
            buffer = []
    if buffer:
        yield table(buffer)


def _each(rows: DataFrame, by: list[str], groups: int, work: Callable[[dict, list], dict], out: str) -> DataFrame:
    """work(key, rows) for every group of rows, each group in one task; its dicts as a table.  Small clusters get fewer tasks than groups."""
    groups = min(groups, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in out.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in it for r in batch.to_pylist())
        for key, own in groupby(stream, lambda r: tuple(r[b] for b in by)):
            yield pa.RecordBatch.from_pylist([work(dict(zip(by, key)), list(own))], schema)

    # in turn where the key is one number, so that tasks have equally many files
    dealt = rows.repartitionById(max(1, groups), F.pmod(F.col(by[0]), F.lit(max(1, groups))).cast("int")) if len(by) == 1 else rows.repartition(max(1, groups), *by)
    return dealt.sortWithinPartitions(*by).mapInArrow(run, out)


def _narrowed(parts: DataFrame, files: int, folder: str, staging: str, scratch: Scratch, fan_in: int) -> DataFrame:
    """Slices of which no file has more than fan_in: groups of more are merged into runs of their own first."""
    while (most := parts.groupBy("file_no").count().agg(F.max("count")).first()[0] or 0) > fan_in:
        numbered = parts.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("file_no").orderBy("run", "low")) - 1) / fan_in))

        def work(key: dict, rows: list) -> dict:
            path = f"{folder}/{key['file_no']}-{key['batch']}-{most}.parquet"
            with published(path, staging) as out:
                writer, n = None, 0
                for t in merge([(r["run"], r["low"], r["high"]) for r in rows]):
                    writer = writer or pq.ParquetWriter(out, t.schema)
                    writer.write_table(t)
                    n += t.num_rows
                writer.close()
            return {"file_no": key["file_no"], "run": path, "low": 0, "high": n}

        groups = files * math.ceil(most / fan_in)
        parts = scratch.keep(_each(numbered, ["file_no", "batch"], groups, work, "file_no long, run string, low long, high long"), "slices")
    return parts


_START = "file_no long, version long, n_rows long, start_columns string, path string"


def start_files(table: DataFrame, folder: str, files: int = FILES, fan_in: int = FAN_IN) -> DataFrame:
    """Sort table into starting files in folder, drifted by version; their manifest as a kept table."""
    spark, staging = table.sparkSession, f"{folder}-staging"
    with Scratch(spark) as scratch:
        runs = spill(table, scratch)
        total, begins = cuts(runs, files)
        n = len(begins) + 1 if total else 0
        parts = scratch.keep(slices(runs, begins), "slices")
        parts = _narrowed(parts, n, scratch.folder("merged"), staging, scratch, fan_in)

        def work(key: dict, rows: list) -> dict:
            version = version_of(key["file_no"])
            schema, path, n_rows = schema_of(version), f"{folder}/part-{key['file_no']:05d}-0.parquet", 0
            names = [EVOLVED[_field_id(f) - 1][0] for f in schema]
            with published(path, staging) as out, pq.ParquetWriter(out, schema) as writer:
                for t in merge([(r["run"], r["low"], r["high"]) for r in rows]):
                    columns = [t.column(c).cast(f.type, safe=False) for c, f in zip(names, schema)]
                    writer.write_table(pa.Table.from_arrays(columns, schema=schema))
                    n_rows += t.num_rows
            return {"file_no": key["file_no"], "version": version, "n_rows": n_rows, "start_columns": ",".join(schema.names), "path": path}

        manifest = keep(_each(parts, ["file_no"], n, work, _START), "manifest")
    delete(spark, staging)
    return manifest


# --- rewriting -----------------------------------------------------------------------------------------------------


def evolved(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of a drifted file in the evolved schema: columns by field id, widened, missing ones filled."""
    at = {_field_id(f): i for i, f in enumerate(batch.schema)}
    target = schema_of(0)
    columns = [batch.column(at[i]).cast(f.type) if (i := _field_id(f)) in at else pa.repeat(pa.scalar(MISSING[f.name], f.type), batch.num_rows) for f in target]
    return pa.RecordBatch.from_arrays(columns, schema=target)


_REWRITTEN = _START + ", rewritten boolean, superseded string"


def rewritten(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite the manifest's drifted files; the manifest of the final files, as a kept table.  Files of version 0 are not opened.

    The files it supersedes stay until `described` or another user of the manifest removes them.
    """
    staging = f"{folder}-staging"

    def work(key: dict, rows: list) -> dict:
        row = rows[0]
        if not row["version"]:
            return row | {"rewritten": False, "superseded": None}
        path = f"{folder}/part-{key['file_no']:05d}-1.parquet"
        system, place = store(row["path"])
        with system.open_input_file(place) as f, published(path, staging) as out, pq.ParquetWriter(out, schema_of(0)) as writer:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=WRITTEN):
                writer.write_batch(evolved(batch))
        return row | {"path": path, "rewritten": True, "superseded": row["path"]}

    final = keep(_each(manifest, ["file_no"], manifest.count(), work, _REWRITTEN), "manifest")
    delete(manifest.sparkSession, staging)
    return final


def _spelled(v: float | None) -> str:
    return "?" if v is None else str(math.floor(1048576 * v)) if math.isfinite(v) else str(v)


def described(final: DataFrame) -> DataFrame:
    """Every final file as it is read back: rows, nulls, digests of ids and rows, columns.  Files that the manifest supersedes are deleted."""

    def work(key: dict, rows: list) -> dict:
        row, n_rows, n_nulls, joint = rows[0], 0, 0, ""
        if row["superseded"]:
            remove(row["superseded"])
        ids, lines = hashlib.sha256(), hashlib.sha256()
        system, place = store(row["path"])
        plain = lambda c: ["?" if v is None else str(v) for v in c.to_pylist()]
        with system.open_input_file(place) as f:
            file = pq.ParquetFile(f)
            columns = ",".join(file.schema_arrow.names)
            for batch in file.iter_batches(batch_size=WRITTEN):
                spelt = [[_spelled(v) for v in c.to_pylist()] if name == "balance" else plain(c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c) for name, c in zip(batch.schema.names, batch.columns)]
                ids.update((joint and ",").encode() + ",".join(spelt[0]).encode())
                lines.update(joint.encode() + "\n".join(map("|".join, zip(*spelt))).encode())
                n_rows, n_nulls, joint = n_rows + batch.num_rows, n_nulls + sum(c.null_count for c in batch.columns), "\n"
        facts = {"n_rows": n_rows, "n_nulls": n_nulls, "ids_sha256": ids.hexdigest(), "rows_sha256": lines.hexdigest(), "columns": columns}
        return row | facts

    out = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"
    return _each(final, ["file_no"], final.count(), work, out)


def sorted_and_rewritten(table: DataFrame) -> DataFrame:
    """Cut table into starting files in a new folder of the shared one, which stays, rewrite the drifted ones there, and describe all."""
    folder = new_path(table.sparkSession, "clients")
    return keep(described(rewritten(start_files(table, folder), folder)), "rewritten")
