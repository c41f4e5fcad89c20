"""Connected components of a link table by alternating star contractions.

Every round is one or two shuffles of at most as many rows as there are links, and is written to the shared folder, so no
part of the graph ever comes to the driver. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailveil.llm import rows


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the smallest node it is linked with, for every node of a link; other nodes are not listed.

    Links to a node itself and repeated links do no harm. An empty table gives an empty one.
    """
    edges = rows.stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct())
    last = None
    while True:
        # Large star: all larger neighbours of a node point to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        before, edges = edges, rows.stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        rows.discard(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.col("u").cast("decimal(38,0)")).alias("t")).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
