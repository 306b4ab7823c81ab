"""Ordered lines of rows under hot keys: running values and folds by cells, orbits of successor pointers, folds in levels.

A line is all rows of a key in the order of a number (an instant or a sequence number) and tie-breakers.  No line is sorted
whole: it is cut into cells of `width`, values run within a cell, and each cell gets what the cells before it leave over, from
a table with one row a cell.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.sources.scratch import cut, drop

MICROS = 1_000_000
HOUR = 3600 * MICROS
#: Elements that one step of a fold takes together.
CHUNK = 1024


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, width: int, how: str = "last", ahead: bool = False, own: bool = True) -> DataFrame:
    """rows with `name`: the last non-null value, the maximum or the sum over the row's line up to it.

    ahead: from the line's end down to the row; own=False: without the row itself.  by and order[0], an integer, are never null.
    """
    kinds = {"last": (lambda c: F.last(c, ignorenulls=True), F.coalesce), "max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))}
    over, joined = kinds[how]
    turn = F.desc if ahead else F.asc
    rows = rows.withColumns({"_cell": F.floor(F.col(order[0]) / width), "_v": value})
    frame = lambda w, last: w.rowsBetween(W.unboundedPreceding, last)
    inside = over("_v").over(frame(W.partitionBy(*by, "_cell").orderBy(*map(turn, order)), 0 if own else -1))
    place = F.when(F.col("_v").isNotNull(), F.struct(*order))
    whole = {"last": (F.min_by if ahead else F.max_by)("_v", place), "max": F.max("_v"), "sum": F.sum("_v")}[how]
    cells = rows.groupBy(*by, "_cell").agg(whole.alias("_w"))
    cells = cells.select(*by, "_cell", over("_w").over(frame(W.partitionBy(*by).orderBy(turn("_cell")), -1)).alias("_before"))
    rows = rows.withColumn("_inside", inside).join(cells, [*by, "_cell"])
    return rows.withColumn(name, joined(F.col("_inside"), F.col("_before"))).drop("_cell", "_v", "_inside", "_before")


def orbit(hops: DataFrame, first: DataFrame, by: list[str]) -> DataFrame:
    """(by..., _at): the places reached from `first` (by..., _at) by following hops (by..., _at, _nxt) again and again.

    Pointers are doubled: a round adds the next 1, 2, 4, ... places of every line, so a line of n places takes log2(n) rounds of joins on
    single places, however hot its key.
    """
    hops, marks = cut(hops.where("_nxt is not null")), cut(first.select(*by, "_at"))
    while True:
        new = cut(marks.join(hops, [*by, "_at"]).select(*by, F.col("_nxt").alias("_at")))
        if new.isEmpty():
            drop(hops, new)
            return marks
        far = hops.select(*by, F.col("_at").alias("_nxt"), F.col("_nxt").alias("_far"))
        more, further = cut(marks.unionByName(new)), cut(hops.join(far, [*by, "_nxt"]).select(*by, "_at", F.col("_far").alias("_nxt")))
        drop(marks, new, hops)
        marks, hops = more, further


def streamed(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple], out: str) -> DataFrame:
    """Fold each group of rows in order, row by row, with a small state: step(state, row) gives (state, dict of the columns in out)."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in out.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for row in (r for batch in it for r in batch.to_pylist()):
            if (now := tuple(row[b] for b in by)) != key:
                key, state = now, start()
            state, told = step(state, row)
            done.append(told)
            if len(done) == 5000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, out)


#: Rows of a key that make a cell of folded(), about.
CELL_ROWS = 100_000


def _each(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def folded(rows: DataFrame, by: str, order: list[str], using: list[str], survey: Callable[[], object], after: Callable[[object, object], object], step: Callable[..., tuple], out: str, width: int | None = None) -> DataFrame:
    """rows with the columns `out`: each key's rows in order go through step(state, *values of `using`) -> (new state, tuple of columns).

    A state is None before a key's first row and holds what JSON holds.  Lines are cut into cells of order[0], an integer; no cell waits for
    another: survey() gives an object whose add(*values) takes a cell's rows in order without knowing the state before them and whose
    told() is a short JSON value with after(told, state) the state behind the cell.  States pass from cell to cell over a table of one row a
    cell; then the rows of each are told apart.  Cells are `width` wide; without a width a key of few rows is one cell, others are
    cut evenly to about CELL_ROWS rows each.  by and order are never null.
    """
    at = F.col(order[0])
    if width:
        rows = rows.withColumn("_cell", F.floor(at / width))
    else:
        # few keys have so many rows that they are cut
        hot = rows.groupBy(by).agg(F.count("*").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high")).where(F.col("_n") > CELL_ROWS)
        hot = hot.select(by, "_low", ((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_n") / CELL_ROWS)).alias("_wide"))
        rows = rows.join(F.broadcast(hot), by, "left").withColumn("_cell", F.coalesce(F.floor((at - F.col("_low")) / F.col("_wide")), F.lit(0).cast("long"))).drop("_low", "_wide")
    key = [by, "_cell"]
    kind = rows.select(*key).schema

    def up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now, done = None, None, []
        for batch in it:
            for k, c, *values in _each(batch, [*key, *using]):
                if (k, c) != cell:
                    if now:
                        done.append({by: cell[0], "_cell": cell[1], "_told": json.dumps(now.told())})
                    cell, now = (k, c), survey()
                now.add(*values)
            if len(done) > 5000:
                yield pa.RecordBatch.from_pylist(done, pa.schema([*map(batch.schema.field, key), ("_told", pa.string())]))
                done = []
        if now:
            done.append({by: cell[0], "_cell": cell[1], "_told": json.dumps(now.told())})
            yield pa.RecordBatch.from_pylist(done, pa.schema([*map(batch.schema.field, key), ("_told", pa.string())]))

    def along(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, state = None, None
        for batch in it:
            before = []
            for k, told in _each(batch, [by, "_told"]):
                if k != line or line is None:
                    line, state = k, None
                before.append(json.dumps(state))
                state = after(json.loads(told), state)
            yield pa.RecordBatch.from_arrays([*map(batch.column, key), pa.array(before, pa.string())], [*key, "_state"])

    def tell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in it:
            told = []
            # a cell's first row brings the state before it
            for before, *values in _each(batch, ["_state", *using]):
                if before is not None:
                    state = json.loads(before)
                else:
                    state, new = step(state, *values)
                    told.append(new)
            if told:
                kept = batch.filter(batch.column("_state").is_null())
                new = [pa.array(c, t) for c, t in zip(zip(*told), made_types)]
                yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in names), *new], [*names, *made_names])

    names = [n for n in rows.columns if n != "_cell"]
    kinds = {"long": (pa.int64(), T.LongType()), "string": (pa.string(), T.StringType()), "boolean": (pa.bool_(), T.BooleanType())}
    made = [(x.split()[0], *kinds[x.split()[1]]) for x in out.split(", ")]
    made_names, made_types = [m[0] for m in made], [m[1] for m in made]
    slim = rows.select(*dict.fromkeys([*key, *order, *using])).repartition(*key).sortWithinPartitions(*key, *order)
    cells = slim.mapInArrow(up, T.StructType([*kind.fields, T.StructField("_told", T.StringType())]))
    states = cells.repartition(by).sortWithinPartitions(*key).mapInArrow(along, T.StructType([*kind.fields, T.StructField("_state", T.StringType())]))
    both = rows.withColumn("_state", F.lit(None).cast("string")).unionByName(states, allowMissingColumns=True)
    both = both.repartition(*key).sortWithinPartitions(*key, F.col("_state").isNull(), *order)
    return both.mapInArrow(tell, T.StructType([*rows.select(*names).schema.fields, *(T.StructField(n, t) for n, _, t in made)]))


Map = list[float]


def before_each(parts: DataFrame, by: list[str], compose: Callable[[Map, Map], Map], width: int = CHUNK) -> DataFrame:
    """(by..., c, before) of parts (by..., c, v array<double>): the composition of the maps of all earlier c of the key, null for the first.

    compose(a, b) is a, then b.  Groups of `width` numbers c are composed in a task each, level upon level, and what stands
    before a group comes down the same way, so no key is gathered.
    """
    kind = parts.select(*by).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    names, ddl = [*by, "c"], f"{kind}, c long"
    parts = parts.select(*by, F.col("c").cast("long").alias("c"), "v")

    def table(rows: list[dict], like: pa.Table, last: str) -> pa.Table:
        return pa.table({**{n: pa.array([r[n] for r in rows], like.schema.field(n).type) for n in names}, last: pa.array([r[last] for r in rows], pa.list_(pa.float64()))})

    def up(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["c"])
        return table([rows[0] | {"c": rows[0]["c"] // width, "v": reduce(compose, (r["v"] for r in rows))}], t, "v")

    def down(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["c"])
        now = rows[0]["base"]
        for r in rows:
            r["before"] = now
            now = compose(now, r["v"]) if now is not None else r["v"]
        return table(rows, t, "before")

    group = F.floor(F.col("c") / width).alias("g")
    many = not parts.groupBy(*by).agg(F.countDistinct(group).alias("n")).where("n > 1").isEmpty()
    base = F.lit(None).cast("array<double>")
    if many:
        above = cut(parts.groupBy(*by, group).applyInArrow(up, f"{ddl}, v array<double>"))
        above = before_each(above, by, compose, width).select(*by, F.col("c").alias("g"), F.col("before").alias("base"))
        parts = parts.withColumn("g", group).join(above, [*by, "g"]).drop("g")
    else:
        parts = parts.withColumn("base", base)
    return parts.groupBy(*by, group).applyInArrow(down, f"{ddl}, before array<double>")
