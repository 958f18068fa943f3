"""Connected components as DataFrame joins; no part of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Columns (v, c): every endpoint of ``edges`` (columns a, b) with its component's label.

    Each round hooks every vertex to its least neighbour (or itself) and contracts the
    edges along these hooks.  Labels should be in an order that has nothing to do with
    the graph, such as digests: then the rounds grow with the logarithm of the size.
    Each round is a written table.  Self loops and repeated edges change nothing; a null
    endpoint drops the edge.
    """
    live = work.write(edges.select("a", "b").where("a <> b").distinct(), f"{name}_edges0")
    hooks, step = [], 0
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = work.write(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), f"{name}_hooks{step}")
        moved = live.join(hook.toDF("a", "pa"), "a").join(hook.toDF("b", "pb"), "b").where("pa <> pb")
        step += 1
        live = work.write(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}_edges{step}")
        hooks.append(hook)
    if not hooks:
        return live.select(F.col("a").alias("v"), F.col("b").alias("c"))
    out = hooks[0].toDF("v", "c")
    for hook in hooks[1:]:
        out = out.join(hook.toDF("c", "next"), "c", "left").select("v", F.coalesce("next", "c").alias("c"))
    return out
