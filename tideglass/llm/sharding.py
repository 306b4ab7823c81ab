"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions, racks and shards.  A row descends: at each node every child draws
-ln(u) / weight with u a hash of (key, child's name), and the least draw wins.  A child's weight is the sum of its
shards' weights, so a row meets each shard in proportion to its weight.  Draws of a child
depend on that child alone: changing the weight of one subtree moves rows only into it or out of
it, siblings keep what they had among themselves.  One more shard is one more
region with one rack (`grown`), so no other node's weight changes and rows move only into it.

Law: `key` - the id and the shard count decide.  Slots number each shard's rows without gaps:
rows are counted by (shard, bucket of a hash), the counts are summed up to offsets, and ranks are
taken inside a bucket, so that no shard's rows meet in one task.

Cases: a null id counts as a key of its own; a null text has no bytes (size 1) and the crc32
of no bytes (0); rows that repeat an id share a shard and get slots of their own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows per bucket of the slot numbering, about.
BUCKET_ROWS = 4_000

Tree = list[tuple[str, list[tuple[str, list[tuple[int, float]]]]]]


def tree(shards: int = 16, racks: int = 2, per_rack: int = 4) -> Tree:
    """regions -> racks -> (shard, weight), all shards of weight 1."""
    out: Tree = []
    for s in range(shards):
        region, rest = divmod(s, racks * per_rack)
        rack = rest // per_rack
        if region == len(out):
            out.append((f"region{region}", []))
        if rack == len(out[region][1]):
            out[region][1].append((f"rack{region}.{rack}", []))
        out[region][1][rack][1].append((s, 1.0))
    return out


def grown(t: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    new = 1 + max((s for _, racks in t for _, shards in racks for s, _ in shards), default=-1)
    return [*t, (f"region{len(t)}", [(f"rack{len(t)}.0", [(new, weight)])])]


def draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of md5(key|name)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def _least(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """Value of the child of the least draw; ties go to the earlier child."""
    if len(children) == 1:
        return children[0][2]
    return F.array_min(F.array(*[F.struct(draw(key, name, w).alias("d"), F.lit(k).alias("k")) for k, (name, w, _) in enumerate(children)])).k


def place(df: DataFrame, key: Column, t: Tree, out: str) -> DataFrame:
    """df with the shard of each row; one level of the tree after the other, only the chosen subtree's draws."""
    weight = lambda racks: sum(w for _, shards in racks for _, w in shards)
    none = F.lit(None).cast("int")
    r = f"{out}_region"
    k = f"{out}_rack"
    df = df.withColumn(r, _least(key, [(name, weight(racks), F.lit(0)) for name, racks in t]).cast("int"))
    rack = none
    for i, (_, racks) in enumerate(t):
        rack = F.when(F.col(r) == i, _least(key, [(name, sum(w for _, w in shards), F.lit(0)) for name, shards in racks]).cast("int")).otherwise(rack)
    df = df.withColumn(k, rack)
    shard = none
    for i, (_, racks) in enumerate(t):
        for j, (_, shards) in enumerate(racks):
            at = _least(key, [(f"shard{s}", w, F.lit(0)) for s, w in shards]).cast("int")
            number = F.element_at(F.array(*[F.lit(s) for s, _ in shards]), at + 1)
            shard = F.when((F.col(r) == i) & (F.col(k) == j), number).otherwise(shard)
    return df.withColumn(out, shard).drop(r, k)


def assign(docs: DataFrame, t: Tree, out: str = "shard") -> DataFrame:
    """docs with the column `out`; all other columns stay, and no row moves between partitions."""
    return place(docs, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), t, out)


def with_slots(rows: DataFrame, shard: str, order: list[str], rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """rows with `slot`: 0, 1, ... within each shard, in the order (bucket, order)."""
    buckets = 1 + rows.count() // rows_per_bucket
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(*order)) - 1
    ranked = rows.withColumn("_rank", rank)
    return ranked.join(offsets, [shard, "_bucket"]).withColumn("slot", F.col("_base") + F.col("_rank")).drop("_bucket", "_rank", "_base")


def layout(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    t = tree(shards)
    utf8 = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    placed = assign(assign(rows, t), grown(t), "grown_shard")
    return with_slots(placed, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
