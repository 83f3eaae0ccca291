"""Connected components over distributed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), a table of ``scratch``: the smallest node reachable from each node that has a link to
    another one.

    Alternates two steps until nothing changes: every node's larger neighbours link to its smallest one,
    then its smaller neighbours do.  Both keep components whole and only shorten paths, so a chain takes a
    logarithmic number of rounds.  Each step is a minimum per node (combined before the shuffle) joined to
    the links; a round ends in a table, and only one row, the count and sum of links, reaches the driver.
    """
    both = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = scratch.write(both)
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == now or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        # large step: to each node's smallest neighbour (or itself) link its larger neighbours
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small step: each node's smaller neighbours and itself link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        shorter = scratch.write(small.filter("u != v").distinct())
        scratch.drop(edges)
        edges = shorter
