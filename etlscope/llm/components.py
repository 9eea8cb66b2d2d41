"""Connected components of an edge table, by alternating large-star and small-star contractions.

Each round is two aggregations with map-side combine and two equi-joins whose hot keys adaptive execution can
split; no node's neighbours are gathered in one row.  The edge table of each round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node in ``edges(a, b)``; root is the least node of the component.

    Self loops and repeated edges are allowed; nodes without another partner do not appear.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    stars = materialize(edges.where(F.col("a") != F.col("b")).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    before = _signature(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _signature(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
