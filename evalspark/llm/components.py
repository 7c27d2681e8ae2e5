"""Connected components of an edge table by alternating large and small stars.

The number of rounds grows with the logarithm of the longest path. A round is two
aggregates and two joins over the edge table; its result is written to the shared
folder, so lineage stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def _fold(edges: DataFrame, name: str) -> DataFrame:
    """(u, v, m): every edge with the least of u and all its neighbours.

    The minima are aggregated map-side first and written out, so that the join's two
    sides are plain exchanges and AQE can split the edges of a hub.
    """
    least = scratch(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the least node reachable.

    Nodes without an edge do not appear. Loops and repeated edges are allowed; no rows
    give no rows.
    """
    now = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    seen = _signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _fold(both, "cc-large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch(large, "cc-large-star")
        small = _fold(large, "cc-small")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = scratch(small.where("u <> v").distinct(), "cc-round")
        last, seen = seen, _signature(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
