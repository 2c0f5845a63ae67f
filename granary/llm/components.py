"""Connected components of an edge table by alternating large-star and small-star rounds, in DataFrame joins only.

Each round hooks neighbours onto the least neighbour: a min() per node, combined before the shuffle, and an equi-join of
edges with those minima, whose hot keys adaptive execution may split. Work is linear in the edges, rounds logarithmic in
practice; every round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import settle


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node that edges connect it with. Nodes without an edge are absent.

    Rows with a null end, loops and repeated edges change nothing. No edges: no rows.
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
    e = settle(e.distinct())
    state = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] == 0 or (now["n"], now["s"]) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = (now["n"], now["s"])
        # Large star: every greater neighbour of u moves to the least of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # Small star: every lesser neighbour of u, and u itself, moves to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
