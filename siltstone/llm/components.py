"""Connected components of a graph held as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b: long) with the least node it reaches; isolated nodes are absent.

    Large stars hang a node's larger neighbours on its least one, small stars its smaller ones; together they turn
    any component of n nodes into one star in about log(n) rounds. A round's edges are written in the shared folder,
    so nothing is ever recomputed, and only a count and a checksum reach the driver. No edges give an empty table.
    """
    e = durable(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        center = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(center, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        after = durable(small, "edges")
        now = _state(after)
        discard(e)
        e = after
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x
