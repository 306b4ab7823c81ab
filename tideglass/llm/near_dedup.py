"""MinHash near-duplicate detection: fast similarity sketches, banding, exact verification.

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its
   set of 5-word shingles, band keys of its sketch (128 coordinates, 32 bands of 4), and one
   byte per coordinate.  Documents with equal sets form a class, which is one node from here on.
2. Classes that share a band are candidates.  Small buckets give all their pairs; in a large
   bucket each member is paired with its nearest few by sketch, bucket by bucket in
   blocks, and after the first components a second pass pairs, again in blocks, what
   is in the bucket but not yet in one component.  A pair is kept for verification if the
   sizes allow the threshold and at least `floor` of 128 sketch bytes agree (at
   J = 0.75 a pair misses that with probability below 1e-5; a pair shares no band with
   probability 5e-6).
3. Each such pair is verified on the full shingle sets (100 * |A & B| >= 75 * |A | B|);
   verified links and classes are joined into components by star contraction.

Cases: null, empty or blank texts have no shingles, link with nothing and are kept; texts
of 1 to 4 words are one shingle; very long texts are read whole; rows that repeat a doc_id are one document (it links with
whatever one of its texts links with, and every such row is returned); an empty table gives
an empty result; further columns are ignored; a null doc_id is never linked and its
component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.components import components
from tideglass.llm.hashing import U64, mix, shingle_sets, slices
from tideglass.llm.shared import SLICE, Scratch, batched, keep, lean, semi, small, small_batches
from tideglass.llm.sketch import band_keys, sketches

T, ROWS = 128, 4
#: Buckets up to this size give all their pairs at once.
SMALL = 48
#: Members of a larger bucket that are compared with each other in one block.
BLOCK = 512
NEAREST = 3
#: Members and visitors that meet in one cell of the second pass.
CELL = 256
FLOOR = 74


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _prints(v: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    """n and the two halves of the fingerprint of each set."""
    m = mix(v ^ U64(0x5851F42D4C957F2D))
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(m)))
    more = np.concatenate((np.zeros(1, U64), np.cumsum(mix(m))))
    return [pa.array(np.diff(b), pa.int64()), *(pa.array((x[b[1:]] - x[b[:-1]]).view(np.int64)) for x in (sums, more))]


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, shingle hashes, bounds) of some documents at a time."""
    for batch in small_batches(it):
        rows = list(zip(batch.column("doc_id").to_pylist(), _texts(batch)))
        for part in slices(rows, lambda r: len(r[1] or b""), SLICE):
            yield pa.array([r[0] for r in part], pa.int64()), *shingle_sets([r[1] for r in part])


@lean
def _profile(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, v, b in _parts(it):
        sk = sketches(v, b, T)
        keys = band_keys(sk, ROWS).view(np.int64)
        # as the lowest bits of a minimum over many elements are uniform, one byte tells coordinates apart
        low = (sk & U64(255)).astype(np.uint8)
        bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([ids, *_prints(v, b), bands, pa.array([x.tobytes() for x in low], pa.binary())], ["doc_id", "n", "f1", "f2", "bands", "sig"])


@lean
def _shingles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, v, b in _parts(it):
        sets = pa.array([v[b[i] : b[i + 1]].tobytes() for i in range(len(ids))], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, *_prints(v, b), sets], ["doc_id", "n", "f1", "f2", "shingles"])


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal sketch bytes of each row of x with each row of y."""
    out = np.zeros((len(x), len(y)), np.int16)
    for k in range(x.shape[1]):
        out += x[:, k, None] == y[None, :, k]
    return out


def _could(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n[:, None], m[None, :]) >= 75 * np.maximum(n[:, None], m[None, :])


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "sig"}
    out["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, T)
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    ok = a != b
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[ok], pa.int64()), pa.array(np.minimum(a, b)[ok], pa.int64())], ["a", "b"])


def _block_pairs(g: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of complete (band, block) groups: all of small buckets, the nearest few of a large one's block."""
    node, n, sig = g["node"], g["n"], g["sig"]
    new = np.concatenate(([True], (g["band"][1:] != g["band"][:-1]) | (g["block"][1:] != g["block"][:-1])))
    group = np.cumsum(new)
    small = g["size_"] <= SMALL
    for d in range(1, SMALL):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
        if not len(i):
            break
        j = i + d
        i, j = (x[100 * np.minimum(n[i], n[j]) >= 75 * np.maximum(n[i], n[j])] for x in (i, j))
        ok = (sig[i] == sig[j]).sum(axis=1) >= FLOOR
        yield _pairs(node[i[ok]], node[j[ok]])
    starts = np.flatnonzero(new)
    for at, end in zip(starts, np.append(starts[1:], len(node))):
        k = min(NEAREST, end - at - 1)
        if small[at] or k < 1:
            continue
        agree = np.where(_could(n[at:end], n[at:end]), _agree(sig[at:end], sig[at:end]), 0)
        np.fill_diagonal(agree, 0)
        j = np.argpartition(-agree, k - 1, axis=1)[:, :k].ravel()
        i = np.repeat(np.arange(end - at), k)
        ok = agree[i, j] >= FLOOR
        yield _pairs(node[at + i[ok]], node[at + j[ok]])


@lean
def _near_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_block_pairs over rows sorted by band and block; a group that a batch cuts is carried over."""
    held: list[dict] = []
    rows = 0
    for batch in it:
        if not batch.num_rows:
            continue
        held.append(_columns(batch))
        rows += batch.num_rows
        if rows < 4000:
            continue
        g = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        last = np.flatnonzero((g["band"] != g["band"][-1]) | (g["block"] != g["block"][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield from _block_pairs({c: x[:cut] for c, x in g.items()})
        held, rows = [{c: x[cut:] for c, x in g.items()}], rows - cut
    if rows:
        yield from _block_pairs({c: np.concatenate([h[c] for h in held]) for c in held[0]})


@lean
def _rest_links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of a block's members with visitors of other components, one for each component met.

    Rows come sorted by cell (main, i, j) and visitor: a cell's members are held, its visitors stream by.
    """
    key, own = None, None
    for batch in it:
        if not batch.num_rows:
            continue
        sets = batch.column("shingles").to_pylist()
        g = _columns(batch.drop_columns(["shingles"]))
        change = np.zeros(batch.num_rows, bool)
        for c in ("main", "i", "j"):
            change[1:] |= g[c][1:] != g[c][:-1]
        cuts = np.flatnonzero(change)
        for at, end in zip(np.concatenate(([0], cuts)), np.append(cuts, batch.num_rows)):
            cell = (g["main"][at], g["i"][at], g["j"][at])
            if key != cell:
                key, own = cell, {c: x[:0] for c, x in g.items()} | {"sets": []}
            out = g["visitor"][at:end].astype(bool)
            mine = at + np.flatnonzero(~out)
            own = {c: np.concatenate((own[c], g[c][mine])) for c in g} | {"sets": own["sets"] + [sets[k] for k in mine]}
            guests = at + np.flatnonzero(out)
            if not len(guests) or not len(own["node"]):
                continue
            agree = _agree(g["sig"][guests], own["sig"])
            agree[~_could(g["n"][guests], own["n"]) | (g["component"][guests][:, None] == own["component"][None, :])] = 0
            a, b = [], []
            for v, row in zip(guests, agree):
                maybe = np.flatnonzero(row >= FLOOR)
                met: set[int] = set()
                for m in maybe[np.argsort(-row[maybe], kind="stable")]:
                    c = own["component"][m]
                    if c not in met and _linked(sets[v], own["sets"][m]):
                        met.add(c)
                        a.append(g["node"][v])
                        b.append(own["node"][m])
            yield _pairs(np.array(a, np.int64), np.array(b, np.int64))


def _linked(x: bytes, y: bytes) -> bool:
    """The contract's test on two full sets."""
    p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
    both = np.concatenate((p, q))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= 75 * (len(p) + len(q) - shared)


@lean
def _verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        good = [i for i in range(len(a)) if _linked(x[i], y[i])]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold on the full sets."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    with batched(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(docs, scratch)


def _near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prof = scratch.keep(docs.mapInArrow(_profile, "doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary"), "profile")
    real = prof.where("n > 0 and doc_id is not null")
    key = ["n", "f1", "f2"]
    classes = real.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # candidates: classes that share a band; equal sets have equal bands, so any row of a class shows them
    reps = scratch.keep(real.join(classes.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"]).dropDuplicates(["node"]).drop("f1", "f2"), "reps")
    banded = reps.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size_")).where("size_ > 1")
    bucket = scratch.keep(banded.join(shared, "band").select("band", "node", "size_"), "bucket")
    nodes = scratch.keep(bucket.select("node").distinct(), "nodes")
    n_nodes = nodes.count()
    info = scratch.keep(semi(reps.select("node", "n", "sig"), nodes, "node", rows=n_nodes), "info")
    which = small(scratch.keep(semi(classes, nodes, "node", rows=n_nodes).withColumnRenamed("rep", "doc_id"), "which"))
    found = semi(docs, which.select("doc_id").distinct(), "doc_id", rows=n_nodes).mapInArrow(_shingles, "doc_id long, n long, f1 long, f2 long, shingles binary")
    sets = scratch.keep(found.join(which, [*key, "doc_id"]).select("node", "shingles").dropDuplicates(["node"]), "sets")

    blocks = F.ceil(F.col("size_") / BLOCK)
    cut = lambda salt: F.when(F.col("size_") <= SMALL, F.lit(0)).otherwise(F.pmod(F.xxhash64("node", "band", F.lit(salt)), blocks))
    # a large bucket is dealt out in blocks; exact copies with one set are one node already
    dealt = bucket.withColumn("block", cut(1).cast("long")).join(info, "node")
    dealt = dealt.select("band", "block", "node", "size_", "n", "sig").repartition("band", "block").sortWithinPartitions("band", "block")
    pairs = dealt.mapInArrow(_near_pairs, "a long, b long")
    first = scratch.keep(_links(pairs, sets), "links")
    seen = scratch.keep(components(first, scratch), "seen")

    # what large buckets still hold in several components: those outside the bucket's main one are checked
    # against all of that component and against each other, cell by cell
    large = bucket.where(F.col("size_") > SMALL).join(seen, "node", "left")
    large = scratch.keep(large.select("band", "node", F.coalesce("component", "node").alias("component")), "large")
    per = large.groupBy("band", "component").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    per = small(scratch.keep(per.select("band", "main"), "mains"))
    guests = scratch.keep(large.join(per, "band").where("component != main").select("main", "node", "component").distinct(), "guests")
    # the tables of one row a component are broadcast if few, so that a giant component's members stay spread
    mains = small(scratch.keep(guests.select("main").distinct(), "main-ids"))
    alone = mains.join(seen.select(F.col("component").alias("main")).distinct(), "main", "left_anti")
    hosts = seen.select("node", F.col("component").alias("main")).join(mains, "main").select("main", "node", F.col("main").alias("component"))
    hosts = hosts.unionByName(alone.select("main", F.col("main").alias("node"), F.col("main").alias("component")))
    cells = lambda c: F.ceil(F.col(c) / CELL).cast("long")
    crowd = scratch.keep(hosts.unionByName(guests), "crowd")
    count = crowd.groupBy("main").agg(F.count("*").alias("n_own")).join(guests.groupBy("main").agg(F.count("*").alias("n_out")), "main")
    count = small(scratch.keep(count, "counts"))
    full = lambda d: d.join(count, "main").join(info, "node").join(sets, "node")
    spot = lambda c: F.pmod(F.xxhash64("node", F.lit(c)), cells(c)).cast("long")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), cells(c) - 1))
    columns = ["main", "i", "j", "node", "n", "sig", "component", "visitor", "shingles"]
    members = full(crowd).withColumn("i", spot("n_own")).withColumn("j", every("n_out")).withColumn("visitor", F.lit(False)).select(columns)
    visitors = full(guests).withColumn("j", spot("n_out")).withColumn("i", every("n_own")).withColumn("visitor", F.lit(True)).select(columns)
    rest = members.unionByName(visitors).repartition("main", "i", "j").sortWithinPartitions("main", "i", "j", "visitor").mapInArrow(_rest_links, "a long, b long")
    second = scratch.keep(rest.distinct(), "rest-links")

    # rows that repeat a doc_id with other texts tie their classes together
    held = real.select("doc_id", *key).distinct()
    many = held.groupBy("doc_id").agg(F.count("*").alias("k"), F.min(F.struct(*key)).alias("least")).where("k > 1")
    many = small(scratch.keep(many.select("doc_id", *[F.col(f"least.{c}").alias(f"_{c}") for c in key]), "repeated"))
    ties = held.join(many, "doc_id").join(classes.select(*key, F.col("node").alias("a")), key)
    ties = ties.join(classes.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("node").alias("b")), [f"_{c}" for c in key]).select("a", "b")
    # components of components
    of = lambda c: seen.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    joined = second.unionByName(ties).join(of("a"), "a", "left").join(of("b"), "b", "left")
    final = scratch.keep(components(joined.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")), scratch), "final")

    # each class's component, named by the least doc_id of its classes
    of_class = classes.join(seen.select("node", F.col("component").alias("c1")), "node", "left").withColumn("c1", F.coalesce("c1", "node"))
    of_class = of_class.join(final.select(F.col("node").alias("c1"), F.col("component").alias("c2")), "c1", "left")
    of_class = scratch.keep(of_class.select(*key, "rep", "node", F.coalesce("c2", "c1").alias("c")), "of-class")
    # one row a component: broadcast if few, so that a giant one's classes stay spread
    names = small(scratch.keep(of_class.where("c != node").select("c").distinct(), "linked"))
    names = small(scratch.keep(of_class.join(names, "c", "left_semi").groupBy("c").agg(F.min("rep").alias("name")), "names"))
    of_class = of_class.join(names, "c", "left").select(*key, F.coalesce("name", "rep").alias("name"))
    out = prof.select("doc_id", *key).join(of_class, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    out = keep(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "near-duplicates")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one whose doc_id is least; all columns stay."""
    found = near_duplicates(docs)  # read when the result is
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return semi(docs, gone, "doc_id", anti=True)
