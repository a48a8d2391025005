"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage, unstage


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 1000) -> DataFrame:
    """(node, component): component is the smallest node reachable.

    Every round rewires edges towards smaller nodes; a hub's edges are kept as
    rows and its minimum is found by a partial aggregate, so no node's
    neighbourhood is collected. Rounds grow as the logarithm of the diameter.
    Self-loops make a node of its own; edges with a null end are left out. Raises
    if the last of ``max_rounds`` still changed edges.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    given = cur = stage(e, "edges")
    nodes = cur.select(F.col("u").alias("node")).union(cur.select("v")).distinct()
    old = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours point to the minimum of the neighbourhood
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours point to the smallest
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = stage(small, "edges")
        sums = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if cur is not given:  # the nodes are read from the first table
            unstage(cur)
        cur = new
        if sums == old:
            break
        old = sums
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return nodes.join(cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
