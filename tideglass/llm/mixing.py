"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source's target is its share of all words by weight, at most CAP times its own words; what a
capped source leaves is shared again by weight until none is above (water filling by aggregates).  A document of a source of rate r = target / words is copied floor(r)
times, and once more with a probability that starts at r - floor(r).

Pivotal rounding.  Two documents with fractional probabilities p, q and sizes s, t exchange mass
(p * s + q * t stays as it is), in a random direction that keeps each expectation, until one
of them is 0 or 1; the other goes on to the next.  A block of documents of one source is folded in
this way to one fractional document; blocks' residuals are folded in the next level of a
reduction tree, and so on until every source has one block, whose residual is drawn at its
probability.  This is done twice: the larger documents of a source (mean size and more) come first, and
what their last residual takes too much or too little is laid on the smaller ones'
probabilities, so that in the end a source misses its target by less than one of its smaller documents.
Documents that repeat (source, id and size) are folded as one entity whose copies are dealt out evenly.

All draws are hashes of seed, level and ids, so reruns agree.

Cases: null texts have size 0; size 0 takes 0 and joins no round; a null source is a source, the last;
ids may be null; rows are never dropped; very long texts are counted whole; rows that repeat id, source and
size are one entity, with equal draws for equal keys; an empty table gives an empty result; mix() ignores further
columns, mixed() returns them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.llm.shared import BROADCAST_ROWS, Scratch, drop, fresh, keep, small

WEIGHTS = (5, 2, 1)
CAP = 3
#: Entities folded in one block, about.
BLOCK = 48
SEED = 20240229


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """sizes with rank: the place of each source by code point, null last; ranges are numbered apart and offset."""
    # strings compare by their UTF-8 bytes, which is the order of code points
    by = F.col("source").asc_nulls_last()
    parts = sizes.repartitionByRange(by).withColumn("part", F.spark_partition_id())
    parts = scratch.keep(parts.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(by))), "ranges")
    before, total = [], 0
    for r in parts.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        before.append((r.part, total))
        total += r.n
    offsets = F.broadcast(parts.sparkSession.createDataFrame(before, "part int, before long"))
    return parts.join(offsets, "part").select("source", "source_size", (F.col("before") + F.col("place") - 1).alias("rank"))


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> with target: water filling of the whole size over capped sources."""
    rank = _ranked(sizes, scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1)
    rows = scratch.keep(rank.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(cap)).alias("ceiling")), "weights")
    # the level rises from round to round as sources reach their ceiling, until none does any more
    level, capped = 0.0, -1
    while True:
        full = F.col("ceiling") <= F.lit(level) * F.col("w") * (1 + 1e-12) if capped >= 0 else F.lit(False)
        r = rows.agg(F.sum(F.when(full, 1).otherwise(0)), F.sum("source_size"), F.sum(F.when(full, F.col("ceiling"))), F.sum(F.when(~full, F.col("w")))).first()
        if r[0] is None or r[0] == capped or not r[3]:
            break
        level, capped = ((r[1] or 0) - (r[2] or 0.0)) / r[3], r[0]
    return rows.select("source", "source_size", F.least("ceiling", F.lit(level) * F.col("w")).alias("target"))


def _unit(*what: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(SEED), *what), F.lit(1 << 52)) / float(1 << 52)


def _fold(level: int) -> Column:
    """Fold the array `block` of (e, p, s) to a struct of the open entity and the list of decided ones."""
    item = "struct<e:struct<a:long,b:long>,p:double,s:double>"
    empty = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast("array<struct<e:struct<a:long,b:long>,v:int>>").alias("done"))
    tiny = 1e-12

    def step(acc: Column, x: Column) -> Column:
        a = acc.open
        pa, sa, pb, sb = a.p * a.s, a.s, x.p * x.s, x.s
        total = pa + pb
        u = _unit(F.lit(level), a.e, x.e)
        # end points of the exchange: all that can go to x, all that can go to a
        up = F.least(sb - pb, pa)
        down = F.least(sa - pa, pb)
        to_x = u < down / (up + down)
        new_a = F.when(to_x, pa - up).otherwise(pa + down)
        new_b = total - new_a
        a_shut = (new_a <= tiny * sa) | (new_a >= sa * (1 - tiny))
        b_shut = (new_b <= tiny * sb) | (new_b >= sb * (1 - tiny))
        decided = lambda e, m, s: F.struct(e.alias("e"), F.when(m * 2 > s, 1).otherwise(0).cast("int").alias("v"))
        opened = F.when(a_shut & b_shut, F.lit(None).cast(item)).when(a_shut, F.struct(x.e.alias("e"), (new_b / sb).alias("p"), sb.alias("s"))).otherwise(F.struct(a.e.alias("e"), (new_a / sa).alias("p"), sa.alias("s")))
        done = F.concat(acc.done, F.when(a_shut, F.array(decided(a.e, new_a, sa))).otherwise(F.array().cast("array<struct<e:struct<a:long,b:long>,v:int>>")), F.when(b_shut, F.array(decided(x.e, new_b, sb))).otherwise(F.array().cast("array<struct<e:struct<a:long,b:long>,v:int>>")))
        both = F.struct(opened.alias("open"), done.alias("done"))
        return F.when(a.isNull(), F.struct(x.alias("open"), acc.done.alias("done"))).otherwise(both)

    return F.aggregate("block", empty, step)


def round_pivotal(entities: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(source, e, p, s) with 0 < p < 1, s > 0 and unique e -> (e, v), v in {0, 1}.

    Sum of v * s per source is the sum of p * s up to the last residual; E[v] = p.
    """
    now, out, level = scratch.keep(entities.select("source", "e", "p", "s"), "mix0"), None, 0
    while True:
        counts = scratch.keep(now.groupBy("source").agg(F.count("*").alias("n")), "counts")
        last = (counts.agg(F.max("n")).first()[0] or 0) <= 2 * block
        blocks = F.when(F.col("n") <= 2 * block, F.lit(1)).otherwise(F.ceil(F.col("n") / block))
        dealt = now.join(small(counts.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        dealt = dealt.withColumn("b", F.pmod(F.xxhash64(F.lit(SEED + level), "e"), blocks))
        item = F.struct(F.xxhash64(F.lit(level), "e").alias("h"), "e", "p", "s")
        grouped = dealt.groupBy("source", "b").agg(F.array_sort(F.collect_list(item)).alias("block"))
        grouped = grouped.withColumn("block", F.transform("block", lambda x: F.struct(x.e.alias("e"), x.p.alias("p"), x.s.alias("s"))))
        folded = scratch.keep(grouped.select("source", _fold(level).alias("r")).select("source", "r.open", "r.done"), f"mix{level + 1}")
        done = folded.select(F.explode("done").alias("d")).select("d.e", "d.v")
        out = done if out is None else out.unionByName(done)
        rest = folded.where("open is not null").select("source", "open.e", "open.p", "open.s")
        if last:
            drawn = F.when(_unit(F.lit("last"), F.col("e")) < F.col("p"), 1).otherwise(0).cast("int")
            return out.unionByName(rest.select("e", drawn.alias("v")))
        now, level = rest, level + 1


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
        # rows that repeat one document are one entity; two hashes make a key without collisions
        e = F.struct(*[F.xxhash64(F.lit(SEED + k), "doc_id", "source", "size").alias(c) for k, c in enumerate("ab")])
        entity = scratch.keep(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")).withColumn("e", e), "entities")
        sizes = scratch.keep(entity.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), "sizes")
        sizes = small(scratch.keep(targets(sizes, scratch, weights, cap).withColumnRenamed("source", "_s"), "sources"))
        entity = entity.join(sizes, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        mass = F.when(F.col("size") > 0, rate * F.col("m")).otherwise(F.lit(0.0))
        # a rate within a hair of a whole number is that number
        whole = F.when(mass - F.floor(mass) > 1 - 1e-9, F.floor(mass) + 1).otherwise(F.floor(mass))
        entity = entity.withColumn("whole", whole.cast("long")).withColumn("p", mass - F.col("whole"))
        open_ = scratch.keep(entity.where("p > 1e-9").select("source", "e", "p", F.col("size").cast("double").alias("s")), "open")
        mean = open_.groupBy("source").agg(F.avg("s").alias("mean"), F.count("*").alias("n"))
        mean = small(scratch.keep(mean.select(F.col("source").alias("_s"), F.when(F.col("n") > 1, F.col("mean")).otherwise(F.lit(0.0)).alias("mean")), "means"))
        open_ = scratch.keep(open_.join(mean, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "sided")
        large = scratch.keep(round_pivotal(open_.where("s >= mean"), scratch), "large")
        # words that the larger ones of each source took beyond their share, laid on the smaller ones
        of = lambda x: F.sum(F.when(F.col("s") < F.col("mean"), x * F.col("s")))
        extra = F.sum(F.when(F.col("s") >= F.col("mean"), (F.col("v") - F.col("p")) * F.col("s")))
        sides = open_.join(large, "e", "left").groupBy("source").agg(extra.alias("extra"), of(F.col("p")).alias("held"), of(1 - F.col("p")).alias("room"))
        sides = small(scratch.keep(sides.withColumnRenamed("source", "_s"), "sides"))
        less = F.col("p") * (1 - F.least(F.col("extra") / F.col("held"), F.lit(1.0)))
        more = F.col("p") + (1 - F.col("p")) * F.least(-F.col("extra") / F.col("room"), F.lit(1.0))
        moved = F.when(F.coalesce("extra", F.lit(0.0)) == 0, F.col("p")).when(F.col("extra") > 0, less).otherwise(more)
        shifted = scratch.keep(open_.where("s < mean").join(sides, F.col("source").eqNullSafe(F.col("_s"))).select("source", "e", moved.alias("p"), "s"), "small")
        inside = "p > 1e-9 and p < 1 - 1e-9"
        drawn = large.unionByName(round_pivotal(shifted.where(inside), scratch)).unionByName(shifted.where(f"not ({inside})").select("e", F.round("p").cast("int").alias("v")))
        full = entity.join(drawn, "e", "left").withColumn("total", F.col("whole") + F.coalesce("v", F.lit(0)))
        spread = full.select("doc_id", "source", "size", "source_size", "target", "total", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
        copies = F.floor(F.col("total") / F.col("m")) + (F.col("i") < F.pmod(F.col("total"), F.col("m"))).cast("long")
        return keep(spread.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")), "mix")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all columns as they are.

    Repeated rows of one document share its copies: rows that repeat doc_id, source and size
    each stand as often as the entity's copies divide, the first ones once more.
    """
    d, s, z, total, m, i, copies, c = fresh(docs.columns, "d", "s", "z", "total", "m", "i", "copies", "c")
    dealt = mix(docs, weights, cap)
    taken = dealt.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(total), F.count("*").alias(m)).where(F.col(total) > 0)
    taken = small(keep(taken.withColumnsRenamed({"doc_id": d, "source": s, "size": z}), "taken"), BROADCAST_ROWS // 4)
    drop(dealt)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (word_count(F.col("text")) == F.col(z))
    rows = docs.join(taken, same)
    # only rows that repeat a document need a number
    many = rows.where(F.col(m) > 1).withColumn(i, F.row_number().over(W.partitionBy(d, s, z).orderBy("text")) - 1)
    rows = rows.where(F.col(m) == 1).withColumn(i, F.lit(0)).unionByName(many)
    number = F.floor(F.col(total) / F.col(m)) + (F.col(i) < F.pmod(F.col(total), F.col(m))).cast("long")
    rows = rows.withColumn(copies, number).where(F.col(copies) > 0)
    return rows.withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{x}`") for x in docs.columns])
