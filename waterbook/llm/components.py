"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def component_roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the bigint edges (a, b): root is the
    component's least node. Each round links nodes to the least neighbour of
    their neighbours (large star) and then of themselves (small star); a
    handful of rounds is enough, as paths shorten by powers. Every round is
    written and read again. Joins are on the node, whose many edges adaptive
    execution can split; no neighbour list is ever gathered.

    Edges with a null end, edges of a node with itself and repeated edges add
    nothing; a node with no other edge is not in the result, so no edge gives
    no row. Other columns are ignored."""
    edges = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        low = large.filter("u <> v").groupBy("u").agg(F.min("v").alias("m"))
        small = large.filter("u <> v").join(low, "u")
        links = small.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        edges = stored(links.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum((F.col("b")).cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(members.select("root", "root").distinct())
