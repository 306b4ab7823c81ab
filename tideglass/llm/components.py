"""Connected components of a link table by alternating large and small stars.

Each star hands every node its least neighbour through one map-side combined
minimum and one join; no node's neighbours are ever gathered in a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.shared import Scratch, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b).  Large: every node's larger neighbours move to its least one; small: its smaller ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # edge (a > b): b's larger neighbour a moves to m(b)
        moved = edges.join(least, edges.b == least.u).select(F.col("a"), F.col("m").alias("b"))
        return moved.where("a > b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = edges.join(least, edges.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).where("a > b").distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its least reachable node.

    Self links and repeated links do no harm; an empty table gives an empty one.  scratch owns the table.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "cc")
    mark = None
    for _ in range(rounds):
        new = scratch.keep(_star(_star(now, True), False), "cc")
        drop(now)
        now = new
        # a star forest: every node has one parent and no parent is itself a child
        row = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
