"""Exact top-k inner products by pivot-table elimination.

Vectors are quantised to integers.  Inner products become distances by one more coordinate: with M the
greatest norm, c' = (c, sqrt(M^2 - |c|^2)) and q' = (q, 0) have |q' - c'|^2 = |q|^2 + M^2 - 2 <q, c>, so the
least distances are the highest scores.  A pivot table holds every candidate's distance to PIVOTS
pivots; by the triangle inequality max_p |d(q', p) - d(c', p)| is a lower bound of d(q', c').

Candidates lie in blocks (rows of one packed array), near ones of one length together, and a few
blocks make a part; queries lie in blocks too.  Each query first gets a threshold, the k-th best score over a
bounded sample of candidates.  Candidates stay in their part; a query block is sent to the parts whose extents its
bounds allow, and there each query takes a block's candidates in the order of their bounds, a slice at a time, and stops at
the first bound beyond its k-th best score.  The bounds carry a margin far above rounding
errors and scores are exact integers, so the result is exact.  Nothing is broadcast but the pivots and the sample.

Cases: vectors that are null or hold null or non-finite components take no part, neither as
query nor as candidate, nor do rows without vec_id; vectors of different lengths, empty ones among them, are read as if
the shorter one went on with zeros; a vector whose squared norm passes 2**52 has no pivot distances: its
scores are computed in whole numbers of any size and returned within the range of a long; a query with fewer
than k candidates gets them all; ties go to the smaller vec_id; rows that repeat a vec_id are candidates of their
own, but never of a query of the same vec_id, and such a query is answered once, for the least of its vectors;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.llm.shared import Scratch, keep, small_batches

K = 5
SCALE = 256.0
PIVOTS = 24
#: Candidates, and bytes of them, of the sample that thresholds and pivots come from.
SAMPLE, SAMPLE_BYTES = 2048, 16_000_000
Q_BLOCK, C_BLOCK = 512, 2048
#: Bytes of a block's vectors, about.
BLOCK_BYTES = 4_000_000
#: Blocks of a part, once there are more than MANY.
PART, MANY = 16, 512
#: Scores below are exact in doubles.
_EXACT = float(1 << 52)
_SLICE = 256
_LONG = (1 << 63) - 1


def usable(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, x array<double>, n, square) of the rows that take part; square: no less than the squared norm once quantised."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null").where(fine)
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + (F.abs(c) * scale + 1) * (F.abs(c) * scale + 1))
    return rows.select("vec_id", "x", F.size("x").alias("n"), square.alias("square"))


def _pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """Places of farthest-first points of the rows."""
    chosen = [0]
    d = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(rows)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows; the shorter ones go on with zeros."""
    m = min(a.shape[1], b.shape[1])
    return a[:, :m] @ b[:, :m].T


class Space:
    """Pivots, their frame, and a bounded sample of candidates; sent to every executor."""

    def __init__(self, sample: list[tuple[int, list[float]]], top: float, scale: float, pivots: int = PIVOTS):
        self.top, self.scale = top, scale
        self.ids = np.array([i for i, _ in sample], np.int64)
        self.rows = self.quantised(np.array([v for _, v in sample], np.float64) if sample else np.zeros((0, 0)))
        at = _pivots(np.hstack((self.rows, self.rest(self.rows)[:, None])), pivots) if sample else np.zeros(0, np.int64)
        self.pivots = self.rows[at]
        self.pivot_rest = self.rest(self.pivots)
        self.margin = 1e-6 * np.sqrt(max(self.top, 1.0)) + 1e-6

    def quantised(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.floor(x * self.scale)

    def whole(self, x: np.ndarray) -> np.ndarray:
        """quantised() as whole numbers of any size."""
        out = np.empty(x.shape, object)
        for at, c in np.ndenumerate(x):
            y = float(c) * self.scale
            out[at] = math.floor(y) if math.isfinite(y) else math.floor(float(c)) * int(self.scale)
        return out

    def rest(self, v: np.ndarray) -> np.ndarray:
        """The further coordinate of candidates."""
        return np.sqrt(np.maximum(self.top - (v * v).sum(axis=1), 0))

    def table(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Distances of quantised rows to the pivots."""
        norm = (v * v).sum(axis=1)[:, None] if query else self.top
        more = 0 if query else self.rest(v)[:, None] * self.pivot_rest[None, :]
        return np.sqrt(np.maximum(norm + self.top - 2 * (_dot(v, self.pivots) + more), 0))

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance beyond which no candidate reaches the score."""
        far = np.sqrt(np.maximum((q * q).sum(axis=1) + self.top - 2 * score, 0)) + self.margin
        return np.where(np.isneginf(score), np.inf, far)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end, vectors) of each run of rows of one length."""
    n = batch.column("n").to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero(n[1:] != n[:-1]) + 1, [len(n)])) if len(n) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        flat = batch.column("x").slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
        yield int(a), int(b), flat.reshape(b - a, int(n[a]))


_BLOCKS = "part int, ids binary, v binary, d binary, least binary, n int, big boolean, low array<double>, high array<double>, far double"


def _packed(space, query: bool):
    """Rows (vec_id, x, n, big), sorted by n and big, to rows of one packed block each."""

    def block(s: Space, part: int, held: list, n: int, big: bool, k: int) -> pa.RecordBatch:
        ids, x = np.concatenate([h[0] for h in held]), np.vstack([h[1] for h in held])
        v = s.quantised(x)
        p = len(s.pivots)
        d = np.zeros((len(x), p)) if big else s.table(v, query)  # big ones may be infinite here
        least = np.full(len(x), -np.inf)
        if query and not big and len(s.rows):
            score = _dot(v, s.rows)
            score[ids[:, None] == s.ids[None, :]] = -np.inf
            if score.shape[1] >= k:
                least = np.partition(score, -k, axis=1)[:, -k]
        far = np.inf if big or not query else float(s.radius(v, least).max())
        # the block's extent: the ends of each pivot's column; that of big vectors is everything
        ends = [np.full(p, -np.inf), np.full(p, np.inf)] if big else [d.min(axis=0), d.max(axis=0)]
        columns = [pa.array([part], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in (ids.astype("<i8"), x.astype("<f8"), d.astype("<f8"), least.astype("<f8")))]
        columns += [pa.array([n], pa.int32()), pa.array([big]), *(pa.array([e.tolist()], pa.list_(pa.float64())) for e in ends), pa.array([far])]
        return pa.RecordBatch.from_arrays(columns, ["part", "ids", "v", "d", "least", "n", "big", "low", "high", "far"])

    def make(k: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, part = space.value, TaskContext.get().partitionId()
            held: list = []
            count, kind = 0, None
            for batch in small_batches(it):
                big = batch.column("big").to_numpy(zero_copy_only=False)
                ids = batch.column("vec_id").to_numpy()
                for a, b, x in _runs(batch):
                    for flag in (False, True):
                        mine = np.flatnonzero(big[a:b] == flag)
                        if not len(mine):
                            continue
                        if held and (kind != (x.shape[1], flag) or count >= limit(x.shape[1])):
                            yield block(s, part, held, *kind, k)
                            held, count = [], 0
                        kind = (x.shape[1], flag)
                        held.append((ids[a:b][mine], x[mine]))
                        count += len(mine)
            if held:
                yield block(s, part, held, *kind, k)

        return run

    limit = lambda n: max(1, min(Q_BLOCK if query else C_BLOCK, BLOCK_BYTES // (8 * max(1, n))))
    return make


def nearest(vectors: DataFrame, every: int = 50, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.keep(usable(vectors, scale), "vectors")
        # not >= so that NaN counts as big
        rows = rows.withColumn("big", ~F.coalesce(F.col("square") < _EXACT, F.lit(False)))
        told = rows.where("not big").groupBy("n").agg(F.count("*").alias("rows"), F.max("square").alias("top"))
        size = told.orderBy(F.desc("rows"), "n").first()
        top = told.agg(F.max("top")).first()[0] or 0.0
        sample = []
        if size is not None:
            some = rows.where(~F.col("big") & (F.col("n") == size.n)).select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id", "x")
            sample = [(r.vec_id, list(r.x)) for r in some.limit(max(k + 1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, size.n))))).collect()]
        space = spark.sparkContext.broadcast(Space(sample, top, scale))
        bulk = rows.agg(F.count("*"), F.sum(F.ceil(F.col("n") * F.lit(8.0 * C_BLOCK) / BLOCK_BYTES)), F.sum(F.when(F.col("vec_id") % every == 0, 1))).first()
        blocks = 1 + max(bulk[0] // C_BLOCK, int((bulk[1] or 0) // C_BLOCK))
        parts = blocks if blocks <= MANY else max(MANY, blocks // PART)

        def located(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = space.value
            for b in small_batches(it):
                near = [np.zeros(0, np.int32)]
                for _, _, x in _runs(b):
                    with np.errstate(over="ignore", invalid="ignore"):
                        near.append(np.nan_to_num(s.table(s.quantised(x))).argmin(axis=1).astype(np.int32) if len(s.pivots) else np.zeros(len(x), np.int32))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "x", "n", "big")), pa.array(np.concatenate(near))], ["vec_id", "x", "n", "big", "near"])

        spread = F.xxhash64("vec_id", "x")
        c = rows.select("vec_id", "x", "n", "big").mapInArrow(located, "vec_id long, x array<double>, n int, big boolean, near int")
        c = c.withColumn("spread", spread).repartitionByRange(parts, "n", "big", "near", "spread").sortWithinPartitions("n", "big", "near", "spread")
        c = scratch.keep(c.select("vec_id", "x", "n", "big").mapInArrow(_packed(space, False)(k), _BLOCKS), "c-blocks")
        q = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
        q = q.select("vec_id", "x", F.size("x").alias("n")).join(rows.select("vec_id", "x", "big").distinct(), ["vec_id", "x"])
        q = q.repartitionByRange(1 + (bulk[2] or 0) // (4 * Q_BLOCK), "n", "big", F.xxhash64("vec_id")).sortWithinPartitions("n", "big", "vec_id")
        q = q.select("vec_id", "x", "n", "big").mapInArrow(_packed(space, True)(k), _BLOCKS)
        q = scratch.keep(q.withColumn("qb", F.monotonically_increasing_id()), "q-blocks")

        # which parts a query block must visit: one short row a part meets one a query block
        wide = lambda f, c: F.array(*[f(F.col(c)[p]) for p in range(len(space.value.pivots))]).cast("array<double>")
        extents = c.groupBy("part").agg(wide(F.min, "low").alias("low"), wide(F.max, "high").alias("high"))
        ends = q.select("qb", F.col("low").alias("q_low"), F.col("high").alias("q_high"), "far").withColumn("i", F.row_number().over(W.orderBy("qb")) - 1)
        wanted = extents.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(0, q.count() - 1))))).join(ends, "i")
        gap = F.array_max(F.transform(F.arrays_zip("low", "high", "q_low", "q_high"), lambda z: F.greatest(z.low - z.q_high, z.q_low - z.high)))
        wanted = wanted.where(F.coalesce(gap <= F.col("far"), F.lit(True))).select(F.col("part").alias("to"), "qb")
        guests = q.join(wanted, "qb").select(F.col("to").alias("part"), F.lit(True).alias("guest"), "ids", "v", "d", "least", "n", "big", "low", "high", "far")
        met = c.select("part", F.lit(False).alias("guest"), "ids", "v", "d", "least", "n", "big", "low", "high", "far").unionByName(guests)
        met = met.repartition(parts, "part").sortWithinPartitions("part", "guest")

        def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = space.value
            part, own = None, []
            for row in small_batches(it, 1):
                r = row.to_pylist()[0]
                if r["part"] != part:
                    part, own = r["part"], []
                block = _Block(r)
                if not r["guest"]:
                    own.append(block)
                    continue
                for c in own:
                    yield from _matches(s, block, c, k)

        found = met.mapInArrow(search, "query_id long, vec_id long, score long, more string")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("more"), "vec_id"))
        return keep(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k")


class _Block:
    def __init__(self, r: dict):
        self.ids, self.least = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["least"], "<f8")
        self.x = np.frombuffer(r["v"], "<f8").reshape(len(self.ids), r["n"])
        self.d = np.frombuffer(r["d"], "<f8").reshape(len(self.ids), -1)
        self.big, self.low, self.high, self.far = r["big"], np.array(r["low"]), np.array(r["high"]), r["far"]


def _order(score: int) -> str:
    """Among scores that a long cannot hold: a string that is greater for a greater one."""
    if abs(score) <= _LONG:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}" + "".join(str(9 - int(d)) for d in digits)


def _matches(s: Space, q: _Block, c: _Block, k: int) -> Iterator[pa.RecordBatch]:
    """The best k of candidate block c for each query of q that may have any there."""
    names = ["query_id", "vec_id", "score", "more"]
    if q.big or c.big:
        # whole numbers of any size
        a, b = s.whole(q.x), s.whole(c.x)
        m = min(a.shape[1], b.shape[1])
        for i, own in enumerate(q.ids.tolist()):
            scores = [sum((x * y for x, y in zip(a[i, :m], v)), 0) for v in b[:, :m]]
            best = sorted((-t, int(j)) for t, j in zip(scores, c.ids.tolist()) if j != own)[:k]
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(best), pa.int64()), pa.array([j for _, j in best], pa.int64()), pa.array([max(-_LONG, min(_LONG, -t)) for t, _ in best], pa.int64()), pa.array([_order(-t) for t, _ in best], pa.string())], names)
        return
    if len(q.low) and np.maximum(c.low - q.high, q.low - c.high).max() > q.far:
        return
    qv, cv = s.quantised(q.x), s.quantised(c.x)
    m = min(qv.shape[1], cv.shape[1])
    bound = np.zeros((len(qv), len(cv)))
    for p in range(q.d.shape[1]):
        np.maximum(bound, np.abs(q.d[:, p, None] - c.d[None, :, p]), out=bound)
    far = s.radius(qv, q.least)
    out_q, out_c, out_s = [], [], []
    for i in np.flatnonzero(bound.min(axis=1) <= far):
        best_i, best_s = _eliminate(s, qv[i], int(q.ids[i]), bound[i], far[i], cv[:, :m], c.ids, k)
        out_q.append(np.full(len(best_i), q.ids[i]))
        out_c.append(best_i)
        out_s.append(best_s)
    if out_q:
        ids = np.concatenate(out_q)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(out_c)), pa.array(np.concatenate(out_s).astype(np.int64)), pa.array([""] * len(ids), pa.string())], names)


def _eliminate(s: Space, q: np.ndarray, own: int, bound: np.ndarray, far: float, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of a block for one query, in the order of the pivot bounds until exact stopping."""
    at = np.flatnonzero(bound <= far)
    at = at[np.argsort(bound[at], kind="stable")]
    best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
    short = q[: c.shape[1]]
    for a in range(0, len(at), _SLICE):
        if bound[at[a]] > far:
            break
        part = at[a : a + _SLICE]
        part = part[ids[part] != own]
        best_i = np.concatenate((best_i, ids[part]))
        best_s = np.concatenate((best_s, c[part] @ short))
        top = np.lexsort((best_i, -best_s))[:k]
        best_i, best_s = best_i[top], best_s[top]
        if len(best_i) == k:
            far = min(far, float(s.radius(q[None, :], best_s[-1:])[0]))
    return best_i, best_s
