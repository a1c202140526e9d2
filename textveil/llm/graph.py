"""Connected components over an edge table, with nothing collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, comp long): the smallest node that each node of an edge reaches.

    Alternating large-star and small-star steps: every node hooks its larger, then
    its smaller neighbours onto the least neighbour it knows, until no edge moves.
    Per-node minima are combined before the shuffle and the join that spreads them
    has an exchange on either side, so a node with very many edges is split by AQE.
    Null and looping edges are ignored; an empty table gives an empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = cut(e, "edges")
    seen = _print(e)
    while seen[0]:
        for larger in (True, False):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else e
            least = cut(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")) if larger else both.groupBy("u").agg(F.min("v").alias("m")), "least")
            j = both.join(least, "u")
            if larger:
                j = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                j = j.select("v", "m").unionByName(j.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = cut(j.filter("u != v").distinct(), "edges")
        now = _print(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
