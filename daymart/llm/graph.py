"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``links (a, b)`` is joined to.

    Each round hangs a node's larger neighbours, then its smaller ones, below its least neighbour; when
    nothing changes any more every node hangs below the least of its component. The links never exceed
    their first number, each round is written to the shared folder, and the driver sees one checksum.
    """
    current = stage(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = hung.unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        current = stage(small)
        after = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after
