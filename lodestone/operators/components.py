"""Connected components by alternating star contraction; every step is a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import drop_written, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge; the component is its least node.

    Each round hangs every node's larger neighbours on its least neighbour, then the smaller ones; components become
    stars in a number of rounds near the logarithm of their size, long chains included. Rows with a null end and loops
    are left out. The rounds' tables are written to the shared folder, so plans stay short.
    """
    u, v = F.col(a), F.col(b)
    pairs = written(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_written(pairs)
        pairs = after
        now = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(pairs.select("v", "v").distinct())
