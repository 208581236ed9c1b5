"""Connected components of links, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root for every end of the links u, v: root is the least id of its component.

    Each round hooks every node to its least neighbour, follows the pointers to their
    ends by doubling, and contracts the links; a round leaves at most half of the nodes
    that still have links. Tables are written after each step, so no lineage grows and
    a lost executor costs one step.
    """
    e = scratch.write(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    roots = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = scratch.write(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        while True:
            above = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            further = scratch.write(parent.join(above, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "jump")
            scratch.drop(parent)
            parent = further
            if further.filter("moved").isEmpty():
                break
        step = parent.select("u", "p")
        if roots is None:
            roots = step.select(F.col("u").alias("id"), F.col("p").alias("root"))
        else:
            roots = scratch.write(roots.join(step.withColumnsRenamed({"u": "root", "p": "next"}), "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")
        ends = e.join(step, "u").select(F.col("p").alias("a"), "v").join(step.withColumnsRenamed({"u": "v", "p": "b"}), "v")
        fewer = scratch.write(ends.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        scratch.drop(e)
        if fewer.isEmpty():
            return roots
        e = fewer


